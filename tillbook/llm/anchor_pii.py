"""Personal data found from anchors: Aho-Corasick marks them, local parsers expand them.

One automaton runs over a copy of the text in small letters and reports at-signs, plus
signs, digits, URL schemes and cues of identifiers, secrets and streets. At each report the
parsers of that anchor read the characters around it, decide where the item begins and ends,
and validate it. An item's span ends the search for its kind up to there, so spans of a kind
never overlap; so does an invalid match of a base kind. What a parser of an added kind read
in vain is not read by it again, so that a text costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of results; the first four are the base.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")

SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "mailto:", "tel:")
#: Words before an account or secret, in the four languages of the texts.
CUES = (
    "account", "acct", "iban", "ssn", "passport", "password", "passwd", "token", "secret",
    "api_key", "apikey", "api-key", "konto", "kontonummer", "ausweis", "cuenta", "pasaporte",
    "compte", "passeport", "customer id", "user id",
)
#: Beginnings of secrets that need no cue.
SHAPES = ("ghp_", "gho_", "github_pat_", "akia", "sk_live_", "xoxb-", "xoxp-")
#: Words of streets by where name and number stand around them.
NUMBER_NAME_WORD = (
    "street", "avenue", "road", "lane", "boulevard", "drive", "square", "court",
    " st", " ave", " rd", " ln", " blvd", " dr", " sq", " ct",
)
NAME_WORD_NUMBER = ("stra\u00dfe", "strasse", "str.", "weg", "allee", "platz", "gasse")
NUMBER_WORD_NAME = ("rue", "avenue", "boulevard", "place", "chemin", "quai", "impasse")
WORD_NAME_NUMBER = ("calle", "avenida", "plaza", "paseo", "camino")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z]+:(?://)?[^\s<>\"'`{}|\\^]+")
_LEAD = re.compile(r"[\x20_-]?(?:(?:number|no\.?|nr\.?|id)(?![A-Za-z0-9]))?\x20?[:=#]?\x20?[\"']?", re.I)
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/+-]*+")
_CUE_FIRST = re.compile(f"(?:{'|'.join(CUES)})[^A-Za-z0-9]", re.I)
_SECRET = re.compile(r"[A-Za-z0-9_-]++")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_HOUSE = re.compile(r"(?:.*[\W_])?([0-9]{1,5}[A-Za-z]?)", re.S)
_NAME = re.compile(r"[^\W\d_][\w'\u2019-]*")
_NUMBER_AFTER = re.compile(r",?\x20(?:n[\u00ba\u00b0.]{0,2}\x20?)?[0-9]{1,4}[A-Za-z]?(?!\w)")
_NUMBER_BEFORE = re.compile(r"(?<!\w)[0-9]{1,4}(?:\x20?(?:bis|ter))?,?\x20$")
_NAMES_AFTER = re.compile(
    r"(?:(?:\x20(?:de|du|des|del|la|le|les|las|los|el))*+\x20(?:[dl]['\u2019])?[A-Z\u00c0-\u00de][\w'\u2019-]*+)++"
)
#: Characters before a street's word that hold a number put before it.
_NUMBER_CHARS = 12

Parser = Callable[[str, int, int, int, int], tuple[int, int, bool] | None]
"""(text, anchor's start, its end, end of the kind's last item, end of what this parser has
read in vain) -> start, end, valid."""


def _email(text: str, at: int, _: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    right = _DOMAIN.match(text, at + 1)
    if not right:
        return None
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    return (start, right.end(), True) if start < at else None


def _ip(text: str, at: int, _: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    m = _IP.match(text, at)
    if not m:  # nor does a match start at a later digit of the run
        return at, _RUN.match(text, at).end(), False
    return at, m.end(), all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(text: str, at: int, _: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    m = _CARD.match(text, at)
    if not m:
        return None
    digits = _digits(m[0])
    return at, m.end(), 13 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, _: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    m = _PHONE.match(text, at)
    return m and (at, m.end(), 9 <= len(_digits(m[0])) <= 15)


def _url(text: str, at: int, end: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    if at and text[at - 1].isalnum():
        return None
    m = _URL.match(text, at)
    if not m:
        return None
    stop = at + len(m[0].rstrip(".,;:!?)]"))
    return at, stop, stop > end


def _account(text: str, at: int, end: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    if at and text[at - 1].isalnum():
        return None
    start = _LEAD.match(text, end).end()
    if start < vain or start == end or _CUE_FIRST.match(text, start):
        return None  # a value is set off from its cue, and is no cue itself
    m = _VALUE.match(text, start)
    if not m:
        return None
    iban = _IBAN.match(text, start)
    if iban:
        found = iban[0].replace(" ", "")
        number = "".join(str(int(c, 36)) for c in found[4:] + found[:4])
        if int(number) % 97 == 1:
            return start, iban.end(), True
    value = m[0].rstrip("._/+-")
    valid = len(value) >= 6 and any("0" <= c <= "9" for c in value)
    return start, start + len(value) if valid else m.end(), valid


def _secret(text: str, at: int, end: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    if at < vain or at and text[at - 1].isalnum():
        return None
    stop = _SECRET.match(text, at).end()
    return at, stop, stop - end >= 16 and any("0" <= c <= "9" for c in text[end:stop])


def _names_before(text: str, at: int, low: int) -> tuple[int, str, int]:
    """Where the capitalised words before ``at`` begin, the word before them and its start;
    words end at blanks, and nothing before ``low`` is read."""
    first = at
    while first > low and text[first - 1] == " ":
        start = first - 1
        while start > low and text[start - 1] != " ":
            start -= 1
        word = text[start : first - 1]
        if not (word[:1].isupper() and _NAME.fullmatch(word)):
            return first, word, start
        first = start
    return first, "", first


def _number_first(text: str, at: int, end: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    """12 Old Mill Road"""
    at += text[at] == " "
    if end < len(text) and text[end].isalnum() or not text[at].isupper():
        return None
    first, word, start = _names_before(text, at, max(free, vain))
    m = first < at and _HOUSE.fullmatch(word)
    return (start + m.start(1), end, True) if m else (at, at, False)


def _number_last(text: str, at: int, end: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    """Hauptstr. 12, Berliner Allee 7a"""
    after = _NUMBER_AFTER.match(text, end)
    if not after:
        return None
    low, start = max(free, vain), at
    while start > low and (text[start - 1].isalpha() or text[start - 1] == "-"):
        start -= 1
    if start == at:  # the word stands by itself: its names are before it
        start = _names_before(text, at, low)[0]
        if start == at:
            return at, at, False
    return (start, after.end(), True) if text[start].isupper() else (at, at, False)


def _street_then_name(text: str, at: int, end: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    """12 rue de la Paix"""
    if at and text[at - 1] != " ":
        return None
    low = max(free, at - _NUMBER_CHARS)
    number = _NUMBER_BEFORE.search(text, low, at)
    names = number and _NAMES_AFTER.match(text, end)
    return (number.start(), names.end(), True) if names else None


def _street_name_number(text: str, at: int, end: int, free: int, vain: int) -> tuple[int, int, bool] | None:
    """calle Mayor 5"""
    if at < vain or at and text[at - 1].isalnum():
        return None
    names = _NAMES_AFTER.match(text, end)
    if not names:
        return None
    after = _NUMBER_AFTER.match(text, names.end())
    return (at, after.end(), True) if after else (at, names.end(), False)


def _anchors() -> dict[str, list[tuple[str, Parser]]]:
    found: dict[str, list[tuple[str, Parser]]] = {"@": [("email", _email)], "+": [("phone", _phone)]}
    for d in "0123456789":
        found[d] = [("ip", _ip), ("card", _card)]
    for kind, parser, words in (
        ("url", _url, SCHEMES),
        ("account", _account, CUES),
        ("account", _secret, SHAPES),
        ("address", _number_first, NUMBER_NAME_WORD),
        ("address", _number_last, NAME_WORD_NUMBER),
        ("address", _street_then_name, NUMBER_WORD_NAME),
        ("address", _street_name_number, WORD_NAME_NUMBER),
    ):
        for word in words:
            found.setdefault(word, []).append((kind, parser))
    return found


_SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _in_small_letters(text: str) -> str:
    """``text`` in small letters, or only A-Z of it where others would change their number:
    every character keeps its place."""
    small = text.lower()
    return small if len(small) == len(text) else text.translate(_SMALL)


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for anchor, parsers in _anchors().items():
        made.add_word(anchor, (len(anchor), [(KINDS.index(k), p) for k, p in parsers]))
    made.make_automaton()
    return made


def spans(text: str, anchors: ahocorasick.Automaton) -> list[list[tuple[int, int]]]:
    """(start, end) of the valid items of each kind, in the order of KINDS and of the text."""
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    free = [0] * len(KINDS)
    vain: dict[Parser, int] = {}
    for last, (length, parsers) in anchors.iter(_in_small_letters(text)):
        at = last + 1 - length
        for kind, parse in parsers:
            if at < free[kind]:
                continue
            item = parse(text, at, last + 1, free[kind], vain.get(parse, 0))
            if item:
                start, end, valid = item
                if valid:
                    found[kind].append((start, end))
                if valid or kind < len(BASE):
                    free[kind] = end
                else:
                    vain[parse] = end
    return found


def _joined(found: list[list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, of in zip(kinds, found, strict=False) for a, b in of)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists kind:start:end by kind and start, in code points; ``base_sha256`` is
    the digest of the list of the four base kinds. A null or empty text has none. Rows
    that repeat repeat; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            counts, digests, lists = [], [], []
            for text in batch.column(1):
                found = spans(text.as_py() or "", anchors)
                counts.append([len(f) for f in found[: len(BASE)]])
                base = _joined(found[: len(BASE)], BASE)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                lists.append(_joined(found, KINDS))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))),
                    pa.array(digests, pa.string()),
                    pa.array(lists, pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redact(text: str, anchors: ahocorasick.Automaton) -> str:
    """``text`` with each item replaced by its kind in brackets; of overlapping ones the first."""
    items = sorted((a, -b, k) for k, of in zip(KINDS, spans(text, anchors), strict=True) for a, b in of)
    out, at = [], 0
    for start, end, kind in items:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = -end
    return "".join([*out, text[at:]])
