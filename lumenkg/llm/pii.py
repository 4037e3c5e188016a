"""Personal data and secrets: each entity gets a keyed surrogate of its own kind and form.

A surrogate follows from a secret key, the kind of the entity and its canonical value, so the same entity
reads the same everywhere (coreference). Digits stay digits, letters keep case and script, punctuation
stays, check digits are right again, and a name keeps gender and script. Two entities must not become
one: all surrogates of the corpus are compared with each other and with all entities that really occur,
and those that clash are drawn again. Texts are not shuffled, but for those with an entity that may have
been drawn again.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, stored

#: Bits of entropy a character from which a value that is called a secret is one, though it has no digit.
RANDOM = 3.2
#: Bits that say which entities were drawn again; each executor holds BITS / 8 bytes.
BITS = 1 << 23

# Forms of address and the gender of the name that follows.
_FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "госпожа", "κυρία")
_MALE = ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "господин", "κύριος")
_EITHER = ("Dr", "Prof", "Professor", "Mx", "Rev", "доктор", "δρ")
# What follows a name as a form of address, and what comes before the name of who is speaking or signs.
_AFTER = ("さん", "様", "氏", "先生")
_SIGNED = ("my name is", "My name is", "full name:", "Full name:", "Name:", "name:", "Patient:", "Customer:", "Contact:", "Kind regards,", "Best regards,", "Sincerely,", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo")
# Kinds of streets, after a number and a name, or at the end of a word before a number.
_STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Boulevard", "Blvd", "Court", "Terrace", "Square")
_STREET_ENDS = ("straße", "strasse", "gasse", "allee", "weg", "platz")
# Beginnings of tokens that are known by their form.
_TOKEN_HEADS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "sk_live_", "rk_live_", "sk_test_", "AIza", "ya29.", "npm_", "hf_")
# Syllables and endings that names are made of.
_SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ha", "jo", "ka", "le", "li", "ma", "me", "na", "no", "pa", "re", "ri", "sa", "so", "ta", "te", "va", "ve", "wi"),
    "cyrillic": ("ба", "ва", "ве", "го", "да", "де", "жа", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "но", "па", "ра", "ро", "са", "се", "та", "те", "фе"),
    "cjk": ("佐", "藤", "山", "木", "中", "村", "小", "林", "加", "田", "吉", "井", "松", "本", "清", "水", "森", "川", "石", "原"),
    "katakana": ("ア", "イ", "カ", "キ", "サ", "シ", "タ", "ト", "ナ", "ニ", "マ", "ミ", "ラ", "リ", "ロ"),
    "greek": ("βα", "γα", "δη", "δο", "θα", "θε", "κα", "κο", "λα", "λε", "μα", "μη", "να", "νι", "πα", "πε", "ρα", "ρο", "σα", "σο", "τα", "τε", "φα", "χα"),
}
_ENDINGS = {
    ("latin", "f"): ("na", "lia", "rina"), ("latin", "m"): ("n", "lo", "rus"), ("latin", "family"): ("man", "ster", "lund", "ck"),
    ("cyrillic", "f"): ("на", "лия", "рина"), ("cyrillic", "m"): ("н", "лий", "слав"), ("cyrillic", "family"): ("енко", "ович", "чук"),
    ("latin", "either"): ("ri", "is", "el"), ("cyrillic", "either"): ("ша", "ня", "си"), ("greek", "either"): ("ι", "ις", "ω"),
    ("cjk", "family"): ("子", "郎", "美"), ("katakana", "family"): ("ン", "ノ", "ヤ"),
    ("greek", "f"): ("να", "λια", "νη"), ("greek", "m"): ("νος", "ρης", "λος"), ("greek", "family"): ("ίδης", "άκης", "όπουλος"),
}

# Lower letters, or all, of scripts, by the first word of their characters' names.
_BLOCKS = {"cyrillic": (0x0430, 0x044F), "greek": (0x03B1, 0x03C1), "hebrew": (0x05D0, 0x05EA), "arabic": (0x0627, 0x063A), "armenian": (0x0561, 0x0586), "georgian": (0x10D0, 0x10F0), "devanagari": (0x0915, 0x0939), "bengali": (0x0995, 0x09A8), "thai": (0x0E01, 0x0E2E), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3), "hangul": (0xAC00, 0xD7A3), "cjk": (0x4E00, 0x9FA5)}
#: Surrogates that there are of kinds of one length; all other kinds grow when draws clash.
SPACE = {"ssn": 665 * 99 * 9999, "ip4": 222 * 256 * 256 * 254}

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])")
_IP4 = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])")
_IP6 = re.compile(r"(?:(?<=IPv6:)|(?<![\w:]))(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9A-Fa-f]{1,4}|(?<=::))(?!\w|:[0-9A-Fa-f:])")
_CARD = re.compile(r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4})(?![\w-])")
_ACCESS = re.compile(r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)")
_SECRET = re.compile(r"(?i)(?<!\w)(token|password|passwd|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([\w/+.~=-]{7,}[\w/+~=-])")
_SECRET_WORDS = ("token", "passw", "secret", "api")
_TOKEN = re.compile(rf"(?<![\w-])(?:(?:{'|'.join(map(re.escape, _TOKEN_HEADS))})[\w-]{{16,}}|eyJ[\w-]{{8,}}\.[\w-]{{8,}}(?:\.[\w-]*)?)(?![\w-])")
_ADDRESS = re.compile(rf"(?<!\w)(?:({'|'.join(_FEMALE + _MALE + _EITHER)})\.? |({'|'.join(map(re.escape, _SIGNED))})\s+)(?=[^\W\d_])")
_HONOUR = re.compile(rf"([\u4e00-\u9fff々]+|[\u30a1-\u30fa\u30fc]{{2,}})(?={'|'.join(_AFTER)})")
# Characters at the end of a place, a firm or an office that may stand before a name.
_PLACE_ENDS = "都道府県市区町村郡州国社部課係局店校院駅"
#: Characters of a family and a given name that are written without a space.
_NAME_CHARS = 4
_STREET = re.compile(rf"(?<![\w-])[0-9]{{1,5}} (?:[A-Z][\w'-]+ ){{1,3}}(?:{'|'.join(_STREETS)})(?!\w)")
_STREET_NO = re.compile(rf"(?<![\w-])[A-ZÄÖÜ][a-zäöüß-]+(?:{'|'.join(_STREET_ENDS)}) [0-9]{{1,4}}[a-z]?(?!\w)")
# What may stand before or between the parts of a name, and endings that are not of the name.
_DEGREES = ("Dr", "Prof")
_PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "bin", "ibn", "al", "el")
_PART = re.compile(r"[^\W\d_]+(?:['’‑-](?!(?:s|S|ll|d|re|ve)\b)[^\W\d_]+)*")
_INITIALS = re.compile(r"(?:[^\W\d_]\. ?)+")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> int:
    """The check digit that goes after the digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _digits(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def _entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _secret(name: str, value: str) -> bool:
    """Whether what follows the name of a secret is one: any password, and other values that are no words. Signs alone are a form to fill in."""
    if not any(map(str.isalnum, value)):
        return False
    return bool(_DIGIT.search(value)) or name[:5].lower() == "passw" or len(value) >= 16 and _entropy(value) >= RANDOM


def script_of(name: str) -> str | None:
    """The script of the first character that has one that names can be drawn in."""
    for c in name:
        kind = unicodedata.name(c, "").split(" ")[0].split("-")[0].lower()
        if kind in _SYLLABLES:
            return kind
    return None


def _honoured(run: str) -> str | None:
    """The name at the end of the characters before an honorific: what follows the end of a place or an office, where that leaves two characters at least; of a longer run the last characters."""
    if len(run) > 3 and script_of(run) == "cjk":
        at = max((k + 1 for k in range(len(run) - 2) if run[k] in _PLACE_ENDS), default=0)
        run = run[max(at, len(run) - _NAME_CHARS) :]
    run = run.lstrip("々")
    return run or None


def _address(s: str) -> str | None:
    """An address of eight groups of four digits; null where it is none."""
    try:
        digits = f"{int(ipaddress.IPv6Address(s)):032x}" if s.strip(":") else ""
        return ":".join(digits[k : k + 4] for k in range(0, 32, 4)) if digits else None
    except ValueError:
        return None


def _parts(text: str, at: int) -> list[tuple[tuple[int, int], str]]:
    """The parts of the name that begins at a place: span (initials beside it are in it) and name. Particles are left out."""
    out: list[tuple[tuple[int, int], str]] = []
    start, end = at, None  # end: of the last part, null while none has come since the initials at start
    while True:
        if (m := _INITIALS.match(text, at)) and text[at].isupper():
            stop = m.start() + len(m[0].rstrip(" "))
            if end is not None:  # after a name: they belong to it
                out[-1] = ((out[-1][0][0], stop), out[-1][1])
            at, start = m.end(), start if end is None else m.end()
            if m[0][-1] != " " and not (at < len(text) and text[at].isalpha()):
                return out
        m = _PART.match(text, at)
        if not m or m[0] in _FEMALE or m[0] in _MALE or m[0] in _SIGNED:
            return out
        word, at = m[0], m.end()
        if word in _DEGREES and not out:
            at += text[at : at + 1] == "."
            start = at + 1
        elif len(word) == 1 and word.isupper() and script_of(word) and (after := _PART.match(text, at + 1)) and len(after[0]) > 1 and after[0][0].isupper():  # an initial without a dot
            if end is not None:
                out[-1] = ((out[-1][0][0], at), out[-1][1])
                start = at + 1
        elif word in _PARTICLES:
            start = at + 1
        elif len(word) > 1 and word[0].isupper() and script_of(word):
            out.append(((start, at), word))
            start = end = at + 1
        else:
            return out
        if text[at : at + 1] != " ":
            return out
        at += 1


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """start, stop, kind and canonical value, in order and apart from each other. Where finds overlap, the earlier in this function's order stays."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []

    def every(pattern: re.Pattern, kind: str, canon: Callable[[str], str | None], group: int = 0) -> None:
        for m in pattern.finditer(text):
            if (value := canon(m[group])) is not None:
                found.append((*m.span(group), kind, value))

    if "@" in text:
        every(_EMAIL, "email", str.lower)
    if any(h in text for h in _TOKEN_HEADS) or "eyJ" in text:
        every(_TOKEN, "secret", str)
    lower = text.lower()
    if any(w in lower for w in _SECRET_WORDS):
        found += [(*m.span(2), "secret", m[2]) for m in _SECRET.finditer(text) if _secret(m[1], m[2])]
    digit = _DIGIT.search(text)
    if digit:
        if "AKIA" in text:
            every(_ACCESS, "secret", str)
        if ":" in text:
            every(_IP6, "ip6", _address)
        every(_IP4, "ip4", lambda s: s if all(int(o) < 256 for o in s.split(".")) else None)
        every(_IBAN, "iban", lambda s: v if _mod97(v := s.replace(" ", "")) == 1 else None)
        every(_CARD, "card", lambda s: d if (d := _digits(s)).isascii() and _luhn(d[:-1]) == int(d[-1]) else None)
        every(_SSN, "ssn", _digits)
        every(_PHONE, "phone", lambda s: d if 8 <= len(d := _digits(s)) <= 15 else None)
        if any(f" {x}" in text for x in _STREETS):
            every(_STREET, "street", str.casefold)
        if any(f"{x} " in text for x in _STREET_ENDS):
            every(_STREET_NO, "street", str.casefold)
    elif "::" in text:
        every(_IP6, "ip6", _address)
    names: dict[str, tuple[str, str]] = {}
    for m in _ADDRESS.finditer(text):
        own = _parts(text, m.end())
        gender = "f" if m[1] in _FEMALE else "m" if m[1] in _MALE else "either"
        for k, (span, name) in enumerate(own):
            kind = f"name:{script_of(name)}:{'family' if k == len(own) - 1 else gender}"
            names[name] = (kind, unicodedata.normalize("NFC", name).casefold())
            found.append((*span, *names[name]))
    if any(a in text for a in _AFTER):
        for m in _HONOUR.finditer(text):
            if name := _honoured(m[1]):
                names[name] = (f"name:{script_of(name)}:family", name)
                found.append((m.end(1) - len(name), m.end(1), *names[name]))
    if names:  # the same names without a form of address, and in capital letters
        for name in list(names):
            names.setdefault(name.upper(), names[name])
            if name.isupper() and len(name) > 1:
                names.setdefault(name.capitalize(), names[name])
        any_name = "|".join(map(re.escape, sorted(names, key=len, reverse=True)))
        for m in re.finditer(rf"(?<!\w)({any_name})(?:(?: [^\W\d_]\.)+(?= (?:{any_name})(?!\w)))?(?!\w)", text):
            found.append((*m.span(), *names[m[1]]))
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    if len(found) > 1:
        from bisect import bisect_left, insort

        for e in found:
            at = bisect_left(taken, (e[0], e[1]))
            if (at == len(taken) or taken[at][0] >= e[1]) and (at == 0 or taken[at - 1][1] <= e[0]):
                insort(taken, (e[0], e[1]))
                out.append(e)
        return sorted(out)
    return found


class _Draw:
    """Pseudo-random numbers from the key, the entity and the number of the draw."""

    def __init__(self, key: bytes, kind: str, canon: str, draw: int):
        self.key, self.seed, self.n, self.pool = key, f"{kind}\x00{draw}\x00{canon}".encode("utf-8", "surrogatepass"), 0, 0
        self.room = 1

    def below(self, n: int) -> int:
        if self.room < n << 32:  # the bias is below one in four billion
            block = hmac.new(self.key, self.n.to_bytes(4, "big") + self.seed, hashlib.sha256).digest()
            self.n, self.pool, self.room = self.n + 1, int.from_bytes(block, "big"), 1 << 256
        self.pool, out = divmod(self.pool, n)
        self.room //= n
        return out

    def like(self, s: str, digits: str = "0123456789", lower: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        """As many characters: a digit for a digit, a letter of its script and case for a letter, others as they are."""
        out = []
        for c in s:
            if c in "0123456789":
                out.append(digits[self.below(len(digits))])
            elif c.isdecimal():
                out.append(chr(ord(c) - unicodedata.decimal(c) + self.below(10)))
            elif c.isalpha() and not c.isascii() and (block := _block(c)):
                d = chr(block[0] + self.below(block[1] - block[0] + 1))
                out.append(d.upper() if c.isupper() else d)
            elif c.isalnum():
                d = lower[self.below(len(lower))]
                out.append(d.upper() if c.isupper() else d)
            else:
                out.append(c)
        return "".join(out)

    def letters(self, n: int) -> str:
        return "".join("abcdefghijklmnopqrstuvwxyz"[self.below(26)] for _ in range(n))


def _block(c: str) -> tuple[int, int] | None:
    """The letters to draw from for a letter of a script that is not Latin."""
    script = unicodedata.name(c, "").split(" ")[0].split("-")[0].lower()
    return _BLOCKS.get(script)


def _shares(a: str, b: str, n: int = 4) -> bool:
    """Whether n letters in a row of a are in b."""
    a, b = a.casefold(), b.casefold()
    return any(a[k : k + n].isalpha() and a[k : k + n] in b for k in range(len(a) - n + 1))


def surrogate(key: bytes, kind: str, canon: str, draw: int = 0) -> str:
    """The canonical value of the surrogate. It is drawn again while it has four letters in a row of the entity's."""
    own = _Draw(key, kind, canon, draw)
    for _ in range(8):
        out = _drawn(own, kind, canon, draw)
        if not _shares(*(x.partition(".example")[0] if kind == "email" else x for x in (_own_part(kind, out), _own_part(kind, canon)))):
            break
    return out


def _own_part(kind: str, value: str) -> str:
    """A value without what all of its kind have."""
    if kind == "secret":
        return value[len(_head(value)) :]
    return " ".join(w for w in value.split(" ") if w.capitalize() not in _STREETS) if kind == "street" else value


def _head(secret: str) -> str:
    return next((h for h in ("AKIA", "eyJ", *_TOKEN_HEADS) if secret.startswith(h)), "")


def _drawn(own: _Draw, kind: str, canon: str, draw: int) -> str:
    if kind == "email":
        local, _, domain = canon.partition("@")
        return own.like(local) + own.letters(draw // 4) + "@" + own.like(domain.rpartition(".")[0]) + ".example"
    if kind == "ip4":
        octets = [1 + (own.below(222) + 127) % 223, own.below(256), own.below(256), 1 + own.below(254)]
        return ".".join(map(str, octets))
    if kind == "ip6":
        return "2001:0db8:" + own.like(":".join(g.zfill(4) for g in canon.split(":")[2:]), "0123456789abcdef", "0123456789abcdef")
    if kind == "card":
        body = canon[0] + own.like(canon[1:-1])
        return body + str(_luhn(body))
    if kind == "iban":
        body = canon[:2] + "00" + own.like(canon[4:])
        return body[:2] + f"{98 - _mod97(body):02d}" + body[4:]
    if kind == "ssn":
        return f"{1 + own.below(665):03d}{1 + own.below(99):02d}{1 + own.below(9999):04d}"
    if kind == "phone":
        head = len(canon) - 10 if len(canon) > 10 else 0
        return canon[:head] + str(2 + own.below(8)) + own.like(canon[head + 1 :])
    if kind == "secret":
        hexadecimal = all(c in "0123456789abcdef" for c in canon)
        head = _head(canon)
        # letters are put in after some draws: secrets of few letters and digits must not run out
        return head + own.like(canon[len(head) :], *(("0123456789abcdef",) * 2 if hexadecimal else ())) + own.letters(draw // 4)
    if kind == "street":
        words = []
        for w in canon.split(" "):
            end = next((e for e in _STREET_ENDS if w.endswith(e)), "") if w.isalpha() else w if not w[:1].isalpha() else ""
            if w[:1].isdigit():
                words.append(str(1 + own.below(9)) + own.like(w[1:]))
            elif w.capitalize() in _STREETS and w is not canon.split(" ")[0]:
                words.append(w)
            else:
                words.append("".join(_SYLLABLES["latin"][own.below(25)] for _ in range(3 + draw // 4)) + end)
        return " ".join(words)
    _, script, role = kind.split(":")
    syllables, endings = _SYLLABLES[script], _ENDINGS[script, role]
    # more syllables after some draws: names that are free must not run out
    return "".join(syllables[own.below(len(syllables))] for _ in range(3 + draw // 4)) + endings[own.below(len(endings))]


def rendered(kind: str, value: str, seen: str) -> str:
    """The surrogate in the form in which the entity was seen: its punctuation and case."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(value)
        return "".join(next(chars) if c.isalnum() else c for c in seen)
    if kind == "ip6" and "::" in seen:
        value = str(ipaddress.IPv6Address(value))
    if kind == "email" or kind == "ip6":
        return value.upper() if seen.isupper() else value
    if kind == "street":
        return value.upper() if seen.isupper() else " ".join(w[:1].upper() + w[1:] for w in value.split(" ")[:-1]) + " " + (value.split(" ")[-1] if seen.split(" ")[-1][:1].isdigit() else value.split(" ")[-1].capitalize())
    if kind.startswith("name:"):
        return value.upper() if seen.isupper() else value[0].upper() + value[1:]
    return value


def replaced(text: str, found: list[tuple[int, int, str, str]], key: bytes, draws: dict[tuple[str, str], int], memo: dict) -> str:
    out, at = [], 0
    for start, stop, kind, canon in found:
        name = (kind, canon, draws.get((kind, canon), 0))
        if name not in memo:
            if len(memo) > 100_000:
                memo.clear()
            memo[name] = surrogate(key, *name)
        out += [text[at:start], rendered(kind, memo[name], text[start:stop])]
        at = stop
    return "".join([*out, text[at:]])


def _bit(kind: str, canon: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}\x00{canon}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") % BITS


def occurring(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind and canon of all entities of the corpus, each once."""

    def run(batches):
        for batch in batches:
            own = sorted({e[2:] for t in batch.column(0).to_pylist() for e in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in own], pa.string()) for k in range(2)], names=["kind", "canon"])

    return docs.select(F.col(text).alias("text")).mapInArrow(frugal(run), "kind string, canon string").distinct()


def assigned(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, draw, value: a surrogate for each entity, different from all others and from all entities.

    Of entities that draw the same, the first by canonical value keeps it; the others draw until all are free.
    Only where a kind of SPACE has more than half as many entities as there are surrogates is that an error.
    found must be a table.
    """
    counts = {r["kind"]: r["count"] for r in found.where(F.col("kind").isin(*SPACE)).groupBy("kind").count().collect()}  # a row for each kind of SPACE
    if full := [kind for kind, n in counts.items() if 2 * n > SPACE[kind]]:
        raise ValueError(f"too many entities of a kind: {full}")

    def draw(rows: DataFrame, n: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                kinds, canons = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n] * len(kinds), pa.int32()), pa.array([surrogate(key, k, c, n) for k, c in zip(kinds, canons, strict=True)], pa.string())], names=["kind", "canon", "draw", "value"])

        return stored(rows.select("kind", "canon").mapInArrow(frugal(run), "kind string, canon string, draw int, value string"), "drawn")

    done, rows = None, draw(found, 0)
    for n in count(1):
        taken = found.select("kind", F.col("canon").alias("value"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "value"))
        nth = F.row_number().over(Window.partitionBy("kind", "value").orderBy("canon"))
        judged = rows.withColumn("nth", nth).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "value"], "left")
        judged = stored(judged.select("kind", "canon", "draw", "value", (F.col("taken").isNull() & (F.col("nth") == 1)).alias("free")), "judged")
        good = judged.where("free").drop("free")
        done = good if done is None else done.unionByName(good)
        rest = judged.where("not free")
        if rest.isEmpty():
            return done
        rows = draw(rest, n)


def surrogates(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", n_found: str = "n_entities") -> DataFrame:
    """docs with surrogates in place of entities, and a column ``n_found``: how many were replaced.

    ``n_chars``, where there is such a column, follows the text; a column named ``n_found`` is replaced, all
    others are kept. Long texts are read as a whole. Null and empty texts stay as they are and have no entities; rows that repeat each
    other get the same surrogates; an empty table gives no rows. Numbers with wrong check digits, and
    addresses out of range, are no entities.
    """
    again = assigned(stored(occurring(docs, text), "entities"), key).where("draw > 0").select("kind", "canon", "draw")
    again = stored(again, "again")

    def mark(batches):  # Spark's bitmaps count from 1
        for batch in batches:
            own = [1 + _bit(k, c) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64())], names=["bit"])

    maps = again.mapInArrow(frugal(mark), "bit long").groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = bytearray(BITS // 8 + 4096)
    for row in maps.collect():  # at most BITS / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        bits[at : at + 4096] = row["bits"]
    sent = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    kept = [c for c in docs.columns if c != n_found]
    out = docs.select(*kept).withColumn(n_found, F.lit(0).cast("long")).withColumn("__pii_check", F.lit(None).cast("array<struct<kind:string,canon:string>>"))
    schema = out.schema

    def changed(batch: pa.RecordBatch, texts: list, counts: list, checks: list) -> pa.RecordBatch:
        put = {text: pa.array(texts, batch.schema.field(text).type), n_found: pa.array(counts, pa.int64()), "__pii_check": pa.array(checks, batch.schema.field("__pii_check").type)}
        if n_chars in kept:
            put[n_chars] = pa.array([n if t is None or not k else len(t) for n, t, k in zip(batch.column(n_chars).to_pylist(), texts, counts, strict=True)], batch.schema.field(n_chars).type)
        return pa.RecordBatch.from_arrays([put.get(name, column) for name, column in zip(batch.schema.names, batch.columns, strict=True)], names=batch.schema.names)

    def run(batches):
        there, memo = sent.value, {}
        for batch in batches:
            texts, counts, checks = [], [], []
            for t in batch.column(text).to_pylist():
                found = entities(t)
                check = sorted({e[2:] for e in found if there[(b := _bit(*e[2:])) >> 3] >> (b & 7) & 1})
                texts.append(t if check or not found else replaced(t, found, key, {}, memo))
                counts.append(0 if check else len(found))
                checks.append([{"kind": a, "canon": b} for a, b in check] or None)
            yield changed(batch, texts, counts, checks)

    def rerun(batches):
        memo: dict = {}
        for batch in batches:
            texts, counts = [], []
            for t, own in zip(batch.column(text).to_pylist(), batch.column("__pii_draws").to_pylist(), strict=True):
                found = entities(t)
                texts.append(replaced(t, found, key, {(d["kind"], d["canon"]): d["draw"] for d in own or []}, memo))
                counts.append(len(found))
            batch = batch.select(schema.names)
            yield changed(batch, texts, counts, [None] * len(texts))

    if again.isEmpty():
        return out.mapInArrow(frugal(run), schema).drop("__pii_check")
    first = stored(out.mapInArrow(frugal(run), schema).withColumn("__pii_row", F.monotonically_increasing_id()), "surrogates")
    wanted = first.where("__pii_check is not null").select("__pii_row", F.explode("__pii_check").alias("e")).select("__pii_row", "e.*")
    draws = wanted.join(again, ["kind", "canon"]).groupBy("__pii_row").agg(F.collect_list(F.struct("kind", "canon", "draw")).alias("__pii_draws"))
    second = first.where("__pii_check is not null").join(draws, "__pii_row", "left").select(*schema.names, "__pii_draws").mapInArrow(frugal(rerun), schema)
    return first.where("__pii_check is null").select(*schema.names).unionByName(second).drop("__pii_check")
