"""Generated sentences that teach the trees of ``pii``: values of every kind, lookalikes, and settings around them.

Words come from syllables, leads from lists in several languages; most of the
leads aren't among the cues that ``pii`` reads, and many sentences have no lead.
"""

from __future__ import annotations

import random
import string

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
SYLLABLES = ("an", "be", "cor", "der", "el", "fin", "gra", "ho", "is", "ka", "le", "mon", "na", "or", "pre", "que", "ra", "sch", "ti", "ul", "ver", "wi", "zo")
LEADS = {
    "phone_local": ("Bob's number: ", "reach me on ", "call me at ", "my cell is ", "tel. ", "Telefon: ", "you get her under ", "llámame al ", "ring ", "fax "),
    "national_id": ("he was born; ", "ssn ", "social security no. ", "on file as ", "her id: ", "taxpayer ", "SSN: "),
    "card_short": ("card ", "amex ", "charge it to ", "paid with ", "carte : ", "card number "),
    "account": ("iban ", "IBAN: ", "account no ", "please pay to ", "Konto ", "wire it to ", "compte "),
    "email_words": ("write to ", "mail: ", "me: ", "contact ", "ask "),
    "birth": ("born ", "born on ", "date of birth: ", "DOB ", "geboren am ", "né le ", "her birthday is ", "nacida el "),
    "handle": ("follow ", "twitter: ", "dm ", "ping me ", "by ", "insta "),
    "address": ("client ", "from host ", "login from ", "his address is "),
    "secret": ('token = "', "token=", "api_key: ", "AWS key ", "export SECRET=", "password=", "key='", "Authorization: Bearer ", "secret ", "use "),
    "password": ("password=", "password: ", "Passwort: ", "pwd = ", "passwd:", "secret = '", "mot de passe : ", "login admin password "),
}
COUNTERS = ("order no. ", "version ", "part number ", "isbn ", "ref: ", "invoice ", "serial ", "issue #", "build ", "commit ", "sha256:", "md5 ", "checksum ", "digest: ", "page ", "released on ", "model ", "file ", "img ", "id=", "etag: ")


class Draw(random.Random):
    def of(self, letters: str, n: int) -> str:
        return "".join(self.choice(letters) for _ in range(n))

    def word(self) -> str:
        return "".join(self.choice(SYLLABLES) for _ in range(self.randint(1, 4)))

    def value(self, kind: str) -> str:
        """A value that should be found."""
        d = lambda n: self.of(DIGITS, n)
        if kind == "phone_local":
            return self.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(7)}", f"0{d(2)}/{d(7)}"))
        if kind == "national_id":
            return f"{d(3)}-{d(2)}-{d(4)}"
        if kind == "card_short":
            body = self.choice(("34", "37")) + d(12)
            body += str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body))) % 10)
            return self.choice((body, f"{body[:4]} {body[4:10]} {body[10:]}", f"{body[:4]}-{body[4:10]}-{body[10:]}"))
        if kind == "account":
            parts = [self.choice(("DE", "FR", "GB", "ES", "NL")) + d(2), *(d(4) for _ in range(self.randint(3, 5))), d(2)]
            return self.choice((" ", "")).join(parts)
        if kind == "email_words":
            return self.word() + self.choice((" (at) ", "[at]", " [at] ")) + self.word() + self.choice((".org", " (dot) com", "[dot]net", ".de"))
        if kind == "birth":
            y, m, day = self.randint(1930, 2010), self.randint(1, 12), self.randint(1, 28)
            return self.choice((f"{day:02}.{m:02}.{y}", f"{m:02}/{day:02}/{y}", f"{y}-{m:02}-{day:02}", f"{day}.{m}.{y}"))
        if kind == "handle":
            return "@" + self.word() + self.choice(("", "_" + self.word(), d(2)))
        if kind == "address":
            return ":".join(self.of("0123456789abcdef", self.randint(1, 4)) for _ in range(8))
        if kind == "password":
            return self.choice((self.of(LOWER + UPPER + DIGITS + "!$%&#", self.randint(8, 14)), self.word() + d(3) + "!", self.word().title() + "#" + d(2)))
        return self.choice((
            "AKIA" + self.of(UPPER + DIGITS, 16), "ghp_" + self.of(LOWER + UPPER + DIGITS, 36), "sk_live_" + self.of(LOWER + UPPER + DIGITS, 24), self.of("0123456789abcdef", self.choice((16, 18, 20, 24, 32, 40, 64))),
            self.of(LOWER + UPPER + DIGITS, self.randint(16, 44)), self.of(LOWER + UPPER + DIGITS + "+/", 40) + "==", "xoxb-" + d(11) + "-" + self.of(LOWER + UPPER + DIGITS, 24),
        ))

    def lookalike(self, kind: str) -> str:
        """A harmless value of the same look."""
        d = lambda n: self.of(DIGITS, n)
        if kind == "phone_local":
            return self.choice((f"{d(3)} {d(3)} {d(4)} items", f"0{d(3)} {d(7)} bytes", f"{d(3)}.{d(3)}.{d(4)} km"))
        if kind == "birth":
            return self.choice((f"20{self.randint(11, 25)}-{self.randint(1, 12):02}-{self.randint(1, 28):02}", f"{self.randint(1, 28)}.{self.randint(1, 12)}.20{self.randint(11, 25)}"))
        if kind == "handle":
            return self.choice(("@param", "@return", "@media", "@import", "@Override", "@" + d(3)))
        if kind == "address":
            return ":".join(d(2) for _ in range(self.randint(6, 8)))
        if kind == "password":
            return self.choice(("required", "none", "changed", "forgotten", "<your-password>", "null", "*****", "the same"))
        if kind == "card_short":
            return self.choice(("34", "37")) + d(2) + " " + d(6) + " " + d(5)
        if kind == "account":
            return self.choice(("AB", "XR", "QF")) + d(2) + "".join(" " + self.of(UPPER, 4) for _ in range(3))
        if kind == "secret":
            w = self.word
            return self.choice((
                f"{w()}{w()}{d(2)}{w()}{w()}", f"IMG_20{d(2)}1104_{d(6)}", f"{w()}-{w()}-{w()}-v{d(1)}", f"20{d(2)}-03-04T12", f"{w()}_{w()}_{w()}{d(1)}", f"/{w()}/{w()}/{w()}{d(3)}/{w()}", f"{w()}{d(4)}{w()}{w()}",
                f"{d(4)}-{d(2)}-{w()}-{w()}", f"{self.of(LOWER, 14)}{d(1)}", f"{d(10)}px{d(4)}", f"ISO{d(5)}-{d(1)}-{d(4)}",
            ))
        return self.value(kind)


def sentences(kinds: list[str], n: int, seed: int = 0) -> list[dict]:
    """Rows of text, kind, start and end of the value in it, and label: whether it should be found."""
    draw, rows = Draw(seed), []
    for i in range(n):
        kind = kinds[i % len(kinds)]
        before = " ".join(draw.word() for _ in range(draw.randint(2, 6))) + draw.choice((" ", ", ", ". ", ": ", "\n"))
        turn = draw.random()
        if turn < 0.38:
            lead, value, label = draw.choice(LEADS[kind]), draw.value(kind), 1
        elif turn < 0.55:  # nothing leads to it: its look must tell, which that of a date or a bare word doesn't
            lead, value, label = "", draw.value(kind), int(kind not in ("birth", "password"))
        elif turn < 0.7:
            lead, value, label = draw.choice(COUNTERS), draw.value(kind), 0
        elif turn < 0.88:
            lead, value, label = draw.choice(("", "", draw.choice(COUNTERS))), draw.lookalike(kind), int(kind in ("national_id", "email_words"))
            label *= lead == ""
        else:
            lead, value, label = draw.choice(LEADS[kind]), draw.lookalike(kind), int(kind in ("national_id", "email_words", "birth"))
        start = len(before) + len(lead)
        after = (lead[-1] if lead[-1:] in ("'", '"') else "") + draw.choice((" ", ", ", ". ", " on file ", " tonight ", "\n")) + " ".join(draw.word() for _ in range(draw.randint(1, 4)))
        rows.append({"text": before + lead + value + after, "kind": kind, "start": start, "end": start + len(value), "label": label})
    return rows
