"""Personal data and secrets by candidates and gradient boosting.

Generators with high recall propose spans that may overlap. Each is described by its format (digits,
separators, grouping, checksums) and its context (neighbouring characters, words before it); boosted trees
score it, a sigmoid fitted on held-out rows calibrates the score, and per kind the lowest threshold that
keeps the wanted precision on held-out rows selects what is redacted. A candidate that cannot be of its kind (a
card number fails its checksum, an address has a part over 255) is not asked. The trees are fitted on
sentences made up here from templates, positive and negative, with a fixed seed.

Spans of the plain base patterns always stay; what the trees add never overlaps one of them. Secrets (tokens,
keys, passwords) are a kind of their own beside the four of the base patterns.
"""

from __future__ import annotations

import bisect
import contextlib
import hashlib
import ipaddress
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import tidy

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DOTTED = re.compile(r"[0-9]\.[0-9]")  # in every match of IP
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches per kind that pass the kind's test; a match that fails it is dropped whole."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out["email"].append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text) if DOTTED.search(text) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


MAIL_SIGNS = ("@", "＠", "%40", "&#64;", " dot ")
MAIL_AT = re.compile(r"[\[({<] ?at ?[\])}>]", re.IGNORECASE)
NAME, LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}", r"[A-Za-z0-9-]{1,63}"
MAIL = re.compile(
    rf"{NAME}(?: ?(?:[\[({{<] ?at ?[\])}}>]|＠|%40|&\#64;|@) ?{LABEL}(?: ?[\[({{<] ?dot ?[\])}}>] ?{LABEL}|\.{LABEL}| dot {LABEL}){{1,126}}| at {LABEL}(?: dot {LABEL}){{1,126}})",
    re.IGNORECASE,
)
IP6 = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:.])")
IP_LOOSE = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\.) ?[0-9]{1,3}){3}(?![0-9])")
GAP = "[ .\\-/\u00a0\u2010-\u2013\u202f]"
#: A whole run of digits with single separators, and the usual groupings that may stand inside a longer run.
DIGITS = re.compile(rf"(?<![0-9])[+(]?[0-9](?:[()]?{GAP}{{0,2}}[(]?[0-9]){{8,24}}(?![0-9])")
LONG = re.compile(rf"(?<![0-9])[+(]?[0-9](?:[()]?{GAP}{{0,2}}[(]?[0-9]){{25,}}(?![0-9])")
#: Runs of the characters of DIGITS and LONG: their matches lie within, and no run touches another.
REGION = re.compile(r"[+(]?[0-9][0-9() .\-/\u00a0\u2010-\u2013\u202f]{7,}")
LOOSE = re.compile(r"[0-9] ?[.\[(]")  # in every match of IP_LOOSE
COLONS = re.compile(":[0-9A-Fa-f]{0,4}:")  # in every match of IP6
FORMS = {
    "card": re.compile(rf"(?<![0-9])(?=([0-9]{{13,19}}(?![0-9])|[0-9]{{4}}(?:{GAP}[0-9]{{4}}){{3}}(?![0-9])|[0-9]{{4}}{GAP}[0-9]{{6}}{GAP}[0-9]{{5}}(?![0-9])))"),
    "phone": re.compile(rf"(?<![0-9+])(?=((?:\+[0-9]{{1,3}}{GAP}?)?\(?[0-9]{{2,4}}\)?{GAP}?[0-9]{{3,4}}{GAP}[0-9]{{3,4}}(?![0-9])))"),
}


def may_hold_mail(text: str) -> bool:
    """True wherever MAIL can match: each of its forms has one of these signs."""
    low = text.lower()
    return any(s in low for s in MAIL_SIGNS) or MAIL_AT.search(text) is not None


#: Values long enough for keys, and values of any length after the name of a secret.
KEYLIKE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}(?![A-Za-z0-9_+/=-])")
SECRET_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|auth|private|client)[_ -]?(?:key|secret|token))"
SECRET_SIGNS = ("pass", "pwd", "secret", "token", "key")  # one is in every name
NAMED = re.compile(rf"(?i){SECRET_NAMES}[\"']?[ \t]{{0,3}}(?:[:=]|:=|=>)[ \t]{{0,3}}[\"']?([^\s\"',;<>]{{6,}})")
KEY_PREFIX = re.compile(r"AKIA[0-9A-Z]{16}$|gh[pousr]_|sk-|sk_live_|xox[abps]-|eyJ[A-Za-z0-9_-]+$|glpat-|AIza")


def fits(kind: str, s: str) -> bool:
    """Whether a span has the format that its kind must have."""
    if kind == "card":
        return 13 <= len(d := only_digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(only_digits(s)) <= 15 and s.count("(") == s.count(")")
    if kind == "email":
        return re.search("[A-Za-z]{2,}$", s) is not None
    if kind == "secret":
        return any(c.isalpha() for c in s) and (any("0" <= c <= "9" for c in s) or len(set(s)) > 5)
    with contextlib.suppress(ValueError):
        return ipaddress.ip_address(s if ":" in s else ".".join(str(int(p)) for p in re.findall("[0-9]+", s))) is not None
    return False


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) that might be personal data; spans may overlap, one span may have two kinds."""
    out = []
    if may_hold_mail(text):
        out += [("email", *m.span()) for m in MAIL.finditer(text)]
    if COLONS.search(text):
        out += [("ip", *m.span()) for m in IP6.finditer(text) if len(m[0]) > 6]
    if LOOSE.search(text):
        out += [("ip", *m.span()) for m in IP_LOOSE.finditer(text)]
    regions = [m.span() for m in REGION.finditer(text)]
    for m in (m for span in regions for m in DIGITS.finditer(text, *span)):
        n = len(only_digits(m[0]))
        if 13 <= n <= 19:
            out.append(("card", *m.span()))
        if 9 <= n <= 15:
            out.append(("phone", *m.span()))
        near = text[max(0, m.start() - 1) : m.end()]
        for kind, form in FORMS.items():
            out += [(kind, *span) for f in form.finditer(near) if (span := (max(0, m.start() - 1) + f.start(1), max(0, m.start() - 1) + f.end(1))) != m.span()]
    for m in (m for span in regions for m in LONG.finditer(text, *span)):
        for kind, form in FORMS.items():
            out += [(kind, m.start() + f.start(1), m.start() + f.end(1)) for f in form.finditer(m[0])]
    low = text.lower()
    if any(name in low for name in SECRET_SIGNS):
        out += [("secret", *m.span(1)) for m in NAMED.finditer(text)]
    out += [("secret", *m.span()) for m in KEYLIKE.finditer(text)]
    return [c for c in dict.fromkeys(out) if fits(c[0], text[c[1] : c[2]])]


class Spans:
    """Spans that don't overlap, by place."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):  # base spans may overlap; as one they cover the same
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meet(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s

    def add(self, s: int, e: int) -> None:
        k = bisect.bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


#: Words before a span that speak for or against a kind (fixed values of this operator).
FOR = {
    "email": ("mail", "contact", "write", "reach", "address", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "ping", "client", "login", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "whatsapp", "sms", "telefon", "dial", "text"),
    "secret": ("token", "secret", "pass", "pwd", "key", "auth", "bearer", "credential"),
}
#: Top-level domains that addresses written in words end in.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "nl", "ch", "at", "pl", "jp", "kr")
AGAINST = ("isbn", "issn", "order", "invoice", "version", "serial", "sku", "ref", "ticket", "token", "password", "key", "hash", "id", "page", "fig", "table", "date", "pi", "doi", "batch", "upc", "ean")


def keylike(s: str, before: str) -> tuple[float, ...]:
    """How much a value looks like a key: its alphabet, disorder and what stands before it."""
    upper, lower, digit = (sum(map(test, s)) for test in (str.isupper, str.islower, str.isdigit))
    counts = np.array([s.count(c) for c in set(s)]) / len(s)
    turns = sum((a.isdigit() != b.isdigit()) + (a.isupper() != b.isupper()) for a, b in zip(s, s[1:], strict=False))
    return (
        upper / len(s), lower / len(s), digit / len(s), float(-(counts * np.log2(counts)).sum()), turns / len(s), float(all(c in "0123456789abcdefABCDEF" for c in s)),
        float(bool(re.search(rf"(?i){SECRET_NAMES}[\"']?\s*(?:[:=]|:=|=>)\s*[\"']?$", before))), float(bool(re.search(r"(?i)bearer\s+$", before))), float(bool(KEY_PREFIX.match(s))),
    )


#: Characters of a span that its features look at; the span itself has any length.
LOOKED_AT = 512


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before, after = text[start : min(end, start + LOOKED_AT)], text[max(0, start - 32) : start].lower(), text[end : end + 2]
    digits = only_digits(s)
    letters = sum(c.isalpha() for c in s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    separators = re.sub(r"[0-9A-Za-z]", "", s)
    words = re.findall(r"[a-z]+", before)
    last, first = text[start - 1 : start], after[:1]
    return [
        *(float(kind == k) for k in ALL), len(s), len(digits), letters, len(groups), max(groups, default=0), min(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0,
        len(set(groups)), len(separators), len(set(separators)), float(s.startswith("+")), float("(" in s), float("." in separators), float("-" in separators), float(" " in separators), float("/" in separators),
        float(bool(re.search(r"[0-9)][ .-]{0,2}$", before))), float(bool(re.match(r"[ .-]{0,2}[0-9(]", text[end : end + 4]))), float(bool(re.search(r"[+][0-9]{1,3}[ .-]?$", before))),
        float(bool(re.fullmatch(r"(?:[+]?[0-9]{1,3}[ .-]?)?[(]?[0-9]{2,4}[)]?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}", s))), float(bool(re.fullmatch(r"[0-9]{13,19}|[0-9]{4}(?:[^0-9][0-9]{4}){3}|[0-9]{4}[^0-9][0-9]{6}[^0-9][0-9]{5}", s))),
        float(digits.startswith("00")), float(digits.startswith("0")), float(bool(digits) and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6")), float(len(set(digits)) <= 3),
        float(last.isalnum()), float(first.isalnum()), float(last in "\"'=_#/:"), float(first in "\"'_/:-" and first != ""), float(any(w.startswith(FOR[kind]) for w in words[-4:])), float(any(w in AGAINST or w.startswith(("isbn", "order", "invoice", "version", "token", "pass")) for w in words[-3:])),
        float(any(x in s.lower() for x in ("[at]", "(at)", "{at}", "<at>", "%40", "&#64;", "＠", "[ at ]", "( at )"))), float(" dot " in s.lower() or "dot]" in s.lower() or "dot)" in s.lower()), float(" at " in s.lower()),
        s.count(":"), float("::" in s), max((len(x) for x in re.findall(r"[A-Za-z]+$", s)), default=0), float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}.*", digits))), float(s.count("(") != s.count(")")),
        float(s.lower().endswith(DOMAINS)), *(keylike(s, text[max(0, start - 40) : start]) if kind == "secret" else (0.0,) * 9),
    ]


def made_up(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """n sentences from templates: (text, kind, start, end, label) of every candidate in them."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    pick = rng.choice

    def card(valid: bool) -> str:
        body = pick("3456") + d(pick((12, 13, 14, 14, 14)))
        check = next(str(c) for c in range(10) if luhn(body + str(c)) == valid)
        whole, gap = body + check, pick(("", ".", "/", " ", " ", "-", " - "))
        return gap.join(whole[k : k + 4] for k in range(0, len(whole), 4))

    def phone() -> str:
        a, b, c, gap = pick("23456789") + d(2), d(3), d(4), pick((" ", "-", ".", " "))
        return pick((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}{gap}{b}{gap}{c}", f"0{d(2)}{gap}{d(3)}{gap}{d(4)}", f"00{d(2)}{gap}{d(3)}{gap}{d(5)}", f"1-{a}-{b}-{c}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"(0{d(2)}) {d(4)} {d(3)} {d(2)}", f"(0{d(3)}) {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(7)}", f"0{d(2)}-{d(8)}", f"0{d(4)} {d(3)} {d(3)}"))

    at = lambda: pick((" [at] ", "[at]", " (at) ", "(at)", "{at}", "＠", "%40", "&#64;", " at ", " <at> ", "<at>", " [ at ] ", "( at )", "@", " @ "))
    dot = lambda: pick((" [dot] ", "[dot]", " (dot) ", "(dot)", " dot "))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def email() -> str:
        way = at()
        name = word() + pick(("", "." + word(), "_" + word(), d(2)))
        if way == " at ":
            return f"{name} at {word()} dot {pick(DOMAINS)}"
        return name + way + word() + (dot() if way == "@" else pick((dot(), "."))) + pick(("com", "org", "net", "de"))

    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))

    def secret() -> tuple[str, str]:
        if rng.random() < 0.25:
            return pick(("", "key ", "uses ")), pick(("AKIA" + mixed(16).upper(), "ghp_" + mixed(36), "sk-" + mixed(40), "xoxb-" + d(11) + "-" + mixed(24), "eyJ" + mixed(60), "AIza" + mixed(35)))
        name = pick(("token", "password", "Password", "passwd", "pwd", "secret", "api_key", "API_KEY", "apikey", "access_token", "auth_token", "client_secret", "private key"))
        cue = pick((f'{name} = "', f'{name}="', f"{name}='", f"{name}: ", f"{name} = ", f"{name}=", f'"{name}": "', "Authorization: Bearer ", f"{name}:"))
        return cue, hexes(pick((16, 20, 32, 40, 64))) if rng.random() < 0.4 else mixed(rng.randint(16, 64)) if "earer" in cue or rng.random() < 0.6 else word() + pick("!#$_") + d(rng.randint(2, 5))

    yes = {
        "secret": (None, ()),
        "email": (email, ("mail me: ", "contact ", "write to ", "reach us at ", "")), "phone": (phone, ("tel ", "call ", "phone: ", "fax ", "mobile ", "call me on ", "telefon ")),
        "card": (lambda: card(True), ("card ", "visa ", "paid by credit card no ", "carte ", "tarjeta ", "my amex ")),
        "ip": (lambda: pick((":".join(hexes(4) for _ in range(8)), f"{hexes(4)}:{hexes(3)}::{hexes(2)}", f"fe80::{hexes(4)}:{hexes(4)}", pick(("[.]", "(.)", "[dot]", " . ", " [.] ")).join(str(rng.randint(0, 255)) for _ in range(4)))), ("host ", "ip ", "server ", "from ")),
    }
    no = [
        lambda: ("", d(rng.randint(9, 19))), lambda: (pick(("commit ", "sha1 ", "sha256:", "md5 ", "etag: ", "digest = ", "rev ", "checksum: ", "")), hexes(pick((16, 32, 40, 64)))), lambda: (pick(("", "id ", "uuid: ")), f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"),
        lambda: ("", "-".join(word() for _ in range(rng.randint(3, 6)))), lambda: ("", "_".join(word() for _ in range(rng.randint(3, 6)))), lambda: ("", "/".join(word() for _ in range(rng.randint(3, 6)))), lambda: ("", word() + word() + word() + word()), lambda: (pick(("https://", "www.")), f"{word()}.com/{word()}/{d(6)}/{word()}-{word()}"),
        lambda: (pick(("a token of ", "the password was ", "your secret ", "the key to ", "token: ", "password: see ")), word() + pick((" ", ", ")) + word()), lambda: ("", pick("=-_*+") * rng.randint(16, 40)), lambda: ("", "".join(word().capitalize() for _ in range(4))), lambda: ("", f"{word()}_{d(8)}_{word()}{d(3)}"), lambda: ("", (word() + " ") * 2 + f"{word()}{d(4)}-{word()}{d(4)}-{d(2)}"),
        lambda: ("isbn ", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        lambda: ("order ", d(rng.randint(9, 14))), lambda: ("invoice no ", f"{d(4)}-{d(4)}-{d(4)}"), lambda: ("", f"20{d(2)}-0{pick('123456789')}-1{d(1)} 1{d(1)}:{d(2)}:{d(2)}"), lambda: ("between ", f"{d(4)} - {d(4)} - {d(4)}"),
        lambda: ("", " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(4, 8)))), lambda: ("values ", ". ".join(d(3) for _ in range(4))), lambda: ("", ". ".join(str(rng.randint(1, 99)) for _ in range(4))), lambda: ("card ", card(False)), lambda: ("", f"{word()} at {word()}. {word()} {word()}"),
        lambda: ("met ", f"{word()} at {word()} dot {word()} {word()}"), lambda: ("at ", f"{d(2)}:{d(2)}:{d(2)}"), lambda: ("ratio ", f"{d(1)}:{d(2)}:{d(1)}:{d(1)}"), lambda: ("pi is ", f"3.{d(18)}"), lambda: ("", f"{d(1)},{d(3)},{d(3)},{d(3)}"),
        lambda: ("id ", hexes(8) + d(12)), lambda: ("", word() + d(11) + word()), lambda: ("doi ", f"10.{d(4)}/{d(9)}"), lambda: ("", f"x{d(16)}"), lambda: ("", f"{d(3)}-{d(2)}-{d(4)}-{d(6)}"),
    ]
    out = []
    for _ in range(n):
        beside = ("", "")
        lead, tail = " ".join(word() for _ in range(rng.randint(0, 6))) + pick((" ", ". ", ", ", "\n")), pick((" ", ". ", ", ", "\n")) + " ".join(word() for _ in range(rng.randint(0, 6)))
        if rng.random() < 0.5:
            kind = pick(ALL)
            make, cues = yes[kind]
            cue, body = secret() if kind == "secret" else (pick(cues) if rng.random() < 0.6 else "", make())
            tail = cue[-1] + tail if cue[-1:] in ("'", '"') else tail
            if kind in ("card", "phone") and rng.random() < 0.5:  # next to another number
                other = pick((lambda: card(True), phone, lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: d(rng.randint(1, 6)), lambda: f"10.{d(2)}.{d(2)}.{d(1)}"))()
                beside = pick(((other + " ", ""), ("", " " + other)))
            if kind == "phone" and rng.random() < 0.5:
                body = f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}"
        else:
            kind, (cue, body) = "", pick(no)()
        text, start = lead + cue + beside[0] + body + beside[1] + tail, len(lead + cue + beside[0])
        taken = Spans(x for spans in base_spans(text).values() for x in spans)
        for k, s, e in candidates(text):
            if taken.meet(s, e):
                continue  # never asked
            exact = k == kind and abs(s - start) <= 1 and abs(e - start - len(body)) <= 1
            inside = start - 1 <= s and e <= start + len(body) + 1
            if k == kind and not exact and inside or any(beside) and (e <= start or s >= start + len(body)):
                continue  # a part of the datum teaches nothing, and the number beside may be personal data itself
            out.append((text, k, s, e, int(exact)))
    return out


@lru_cache
def model(n: int = 16_000, precision: float = 0.98, seed: int = 7) -> tuple[boosting.Boosted, float, float, dict[str, float]]:
    """Trees, the calibrating slope and shift, and per kind the threshold; of the rows 1 in 3 is held out to calibrate."""
    rows = made_up(n, seed)
    x, y = np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float)
    out = np.arange(len(rows)) % 3 == 2
    trees = boosting.fit(x[~out], y[~out])
    raw, slope, shift = trees.raw(x[out]), 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic fit with two numbers
        p = boosting.sigmoid(slope * raw + shift)
        g, w = np.array([((y[out] - p) * raw).sum() - 1e-3 * slope, (y[out] - p).sum()]), p * (1 - p) + 1e-9
        h = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        slope, shift = np.array([slope, shift]) + np.linalg.solve(h, g)
    p = boosting.sigmoid(slope * raw + shift)
    kinds, limits = np.array([r[1] for r in rows])[out], {}
    for k in ALL:
        own = kinds == k
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(y[out][own][order]) / np.arange(1, own.sum() + 1)
        fine = np.flatnonzero(good >= precision)
        limits[k] = float(max(0.5, p[own][order][fine[-1]])) if len(fine) else 2.0
    return trees, float(slope), float(shift), limits


def find(text: str, fitted=None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and added spans of a text, by kind, each in order of start; added ones overlap no other."""
    return find_all([text], fitted)[0]


def find_all(texts: list[str], fitted=None, at_once: int = 50_000) -> list[tuple[dict, dict]]:
    """find() of each text; up to about at_once candidates are scored together."""
    fitted = fitted or model()
    found, asked, taken = [], [], {}
    for n, text in enumerate(texts):
        base = base_spans(text)
        found.append((base, {k: [] for k in ALL}))
        taken[n] = Spans(s for spans in base.values() for s in spans)
        for kind, s, e in candidates(text):
            if not taken[n].meet(s, e):
                asked.append((n, kind, s, e))
        if len(asked) >= at_once or n == len(texts) - 1:
            _select(texts, asked, taken, found, fitted, at_once)
            asked, taken = [], {}
    return found


def _select(texts: list[str], asked: list[tuple], taken: dict, found: list[tuple], fitted, at_once: int) -> None:
    """Add the candidates that are sure enough, of overlapping ones the longest, then the surest."""
    trees, slope, shift, limits = fitted
    sure = []
    for k in range(0, len(asked), at_once):
        part = asked[k : k + at_once]
        p = boosting.sigmoid(slope * trees.raw(np.array([features(texts[n], kind, s, e) for n, kind, s, e in part])) + shift)
        sure += [(s - e, -float(v), n, kind, s, e) for (n, kind, s, e), v in zip(part, p, strict=True) if v >= limits[kind]]
    for *_, n, kind, s, e in sorted(sure):
        if not taken[n].meet(s, e):
            taken[n].add(s, e)
            found[n][1][kind].append((s, e))
    for _, added in found:
        for spans in added.values():
            spans.sort()


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def redacted(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, or run of overlapping ones, as its first kind in brackets."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k in ALL for s, e in spans[k]):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Return a row per document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, secrets, n_found and, if asked, redacted.

    The counts and the digest are those of the base spans; spans lists all of the four kinds, by kind and start,
    in code points, and secrets the spans of secrets likewise. n_added counts the spans of the four kinds beyond
    the base ones, n_found all spans. A null text is an empty one, and its redacted text null. Null and repeated
    ids stay, a row each; other columns are ignored.
    """
    fitted = model()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t.as_py() for t in part.column(1)]
                columns: list[list] = [[] for _ in names[1:]]
                for text, (base, added) in zip(texts, find_all([t or "" for t in texts], fitted), strict=True):
                    both = {k: sorted(base.get(k, []) + added[k]) for k in ALL}
                    values = [*(len(base[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(both), sum(len(added[k]) for k in KINDS), listed(both, ("secret",)), sum(map(len, both.values())), redacted(text, both) if with_text and text is not None else None]
                    for c, v in zip(columns, values, strict=True):
                        c.append(v)
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "secrets", "n_found", "redacted"]
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, secrets string, n_found long, redacted string"
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), schema).withColumnRenamed("_id", id_col)
    return out if with_text else out.drop("redacted")


def _matches(kind: str, number: int, pattern: str, test: str) -> str:
    return f"""SELECT rid, {number} AS o, '{kind}' AS kind, m[i] AS s, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM docs) x) y WHERE {test}"""


_DIGITS = "regexp_replace(m[i], '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse({_DIGITS})[k] AS INTEGER) ELSE CAST(reverse({_DIGITS})[k] AS INTEGER) * 2 - CASE WHEN reverse({_DIGITS})[k] > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
#: The base columns of redact over the table documents, as SQL: places follow from the lengths of matches and of what lies between.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), found AS (
""" + "\nUNION ALL ".join([
    _matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    _matches("ip", 1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(m[i], '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT) <= 255, false)))"),
    _matches("card", 2, r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    _matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
]) + """),
spans AS (SELECT rid, count(*) FILTER (WHERE o = 0) AS n_email, count(*) FILTER (WHERE o = 1) AS n_ip, count(*) FILTER (WHERE o = 2) AS n_card, count(*) FILTER (WHERE o = 3) AS n_phone,
  string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(s) AS BIGINT), ',' ORDER BY o, start) AS spans FROM found GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM docs LEFT JOIN spans USING (rid)
"""  # fmt: skip
