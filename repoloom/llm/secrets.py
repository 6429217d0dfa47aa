"""Find and redact credentials in code and configuration (problem 5).

A text is scanned for credentials in their usual contexts (assignments, URLs, headers, options, connection strings,
notes, well-known token forms) and for key containers. Every encoded literal (base64, hexadecimal, percent, backslash
escapes) is decoded, key containers are parsed by their binary grammar (DER, OpenSSH), and a decoded text is scanned
again, layer by layer; what is found inside a literal is reported and redacted as the whole enclosing literal.

A linear-time prefilter over Arrow columns tells for each text which of the scanner's patterns can match in it; only
these are run. The filter of a pattern is derived from the pattern itself by leaving out what only narrows it, so that
it drops no case.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from repoloom.session import spread

#: Words that end the name of a credential. Fixed values.
NAMES = r"pass[_-]?phrase|password|passwd|passcode|pass|pwd|pw|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|signing[_-]?key|encryption[_-]?key|private[_-]?key|auth|authorization|credentials?|creds?|bearer"
#: Forms of tokens that are known by their prefix. Fixed values.
TOKENS = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[0-9A-Za-z-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}|[a-z]{2,5}_(?:live|sec|pat|key)_[A-Za-z0-9]{16,}|[a-z]{1,3}pat_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{30,}|npm_[A-Za-z0-9]{30,}"

_Q = r"(?:\"([^\"\s]{6,})\"|'([^'\s]{6,})'|`([^`\s]{6,})`)"
_ASSIGN = re.compile(r"(?i)(?<![a-z])?(?:" + NAMES + r")[\"'\]\)]{0,3}\s*(?::\s*[a-z]+\s*)?(?::=|=>|=(?!=)|:)\s*\(?\s*" + _Q)
_LOGIN = re.compile(r"(?i)\b(?:login|authenticate|sign_?in)\s*\(\s*[\"'][^\"'\n]*[\"']\s*,\s*" + _Q)
_SQL = re.compile(r"(?i)\bidentified\s+by\s+" + _Q)
_XML = re.compile(r"(?i)<(?:password|secret|token)>([^<\s]{6,})</")
_URL = re.compile(r"://[^\s/\"'@:<>]*:([^\s\"'@]+)@[A-Za-z0-9.\[-]")
_CURL = re.compile(r"\s-u\s+[\"']?[^\s:\"']+:([^\s\"']{6,})")
_HEADER = re.compile(r"(?i)(?:\b(basic|bearer)|(?<=[\"'])(token|apikey))\s+([A-Za-z0-9._~+/=!#$%^&*-]{8,})")
_QUERY = re.compile(r"(?i)[?&](?:" + NAMES + r"|[a-z]+_?(?:token|key)|key|sig|signature)=([^&\s\"'#<>]{8,})")
_OPTION = re.compile(r"(?i)(?<!\S)--?(?:[a-z]+-)*(?:" + NAMES + r")(?:=|\s+)[\"']?([^\s\"']{6,})")
_CONN = re.compile(r"(?i)(?<![a-z])(?:password|pwd)\s*=\s*([^;\s\"'{}<>$]{6,})(?=[;\"'])")
_ENV = re.compile(r"(?im)(?:^|(?<=\r))[ \t]*(?:(?:#|//|--|\*|REM)[ \t]*)?(?:(?:export|set|ENV|old:|was:)[ \t]+)+@?[\w.-]*(?:" + NAMES + r")[ \t]*[=:][ \t]*([^\s\"';]{6,})(?=[ \t]*;?[ \t]*(?:[\r\n]|\Z))")
_LINE = re.compile(r"(?im)(?:^|(?<=\r))[ \t]*(?:(?:#|//|--|\*)[ \t]*)?[\w.-]*(?:" + NAMES + r")(?:=|:[ \t]+)([^\s\"'#;(){}\[\],]{8,})(?=[ \t]*(?:[\r\n]|\Z))")
_FOLDED = re.compile(r"(?im)(?:^|(?<=\r))[ \t]*[\w.-]*(?:" + NAMES + r"):[ \t]*[>|][+-]?[ \t]*\r?\n[ \t]+([^\s\"']{6,})")
_NOTE = re.compile(r"(?i)\b(?:" + NAMES + r"|key|login)\s+(?:(?:is|with|was)\s+)?[\"']?([^\s\"']{8,})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_])(?:" + TOKENS + r")(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BEGIN = re.compile(r"-----BEGIN ")
_BODY = re.compile(r"[A-Za-z0-9+/]{16,}")
#: What stands between the lines or pieces of a key in code, and the header lines of a key.
_BETWEEN = re.compile(r"(?:\\[nrt]|[\s\"'`+,.&|()\[\]\\#*;>]|//(?=\s)|--(?=[ \t])|[bfru](?=[\"'])|(?:Proc-Type|DEK-Info|Version|Comment|MessageID|Hash|Charset): ?[^\r\n\"'`\\]*)*")
#: A line or piece of a key, with nothing behind it on its line but more of the key or the end of a literal.
_KEY_LINE = re.compile(r"(?:=[A-Za-z0-9+/]{4}|[A-Za-z0-9+/]+={0,2})(?=[ \t]*(?:[\"'`\\<\r\n]|-----|\Z)|[ \t]+[A-Za-z0-9+/]{16})")
_COMMENT = re.compile(r"(?m)(?:#|//|--|/\*|^\s*\*)[^\r\n]*")
_PIECE = re.compile(r"(?:[\"'`]\s*(?:\+|\.\.?|\|\||&)?\s*\\?\n?\s*[\"'`])")

#: What a value is that stands for no secret. Fixed values.
_PLACEHOLDER = re.compile(r"(?i)^(?:[<\[{].*[>\]}]|\$.*|%(?:\(\w+\))?[sdr]|%\w+%|\{\{.*|(.)\1+|x{4,}.*|\*{3,}.*|\.{3,}|(?:none|null|nil|true|false|undefined|empty|todo|tbd|n/a|password|passwort|secret|token))$|\$\{|\{\{|<[a-z -]+>|example(?:key|token|pass|secret)?$|change[-_]?me|your[-_ ]|placeholder|redacted|dummy|insert[-_]|replace[-_]|os\.environ|getenv|process\.env|getpass|import\.meta|vault:|ssm:|\*{4,}|xxxxx")


@dataclass(frozen=True)
class Hit:
    """A credential at ``start`` (code point) up to ``end``."""

    start: int
    end: int
    kind: str


def random_like(value: str) -> bool:
    """Letters with digits, signs or inner capitals: no plain word, number, call, path or attribute."""
    if re.fullmatch(r"[\d.,:_-]+", value) or re.search(r"[()\[\]{}<>]", value):
        return False
    letters = re.search(r"[A-Za-z]", value)
    return bool(letters) and bool(re.search(r"\d", value) or re.search(r"[!#$%^&*+=?~@]", value) or len(re.findall(r"[a-z][A-Z]", value)) >= 3)


def usable(value: str, strong: bool) -> bool:
    """Whether a value could be used as a credential. ``strong``: its name or form says that it is one."""
    if len(value) < 6 or _PLACEHOLDER.search(value):
        return False
    if strong and len(value) >= 8 and not re.fullmatch(r"[a-z]+|[A-Z][a-z]+|[a-z_.-]+|[A-Z_]+|\d+", value):
        return "(" not in value or random_like(value.replace("(", ""))
    return random_like(value)


def der_kind(data: bytes) -> str | None:
    """``private`` or ``public`` for a key container in DER or OpenSSH form, else None."""
    if data.startswith(b"openssh-key-v1\0"):
        return "private"
    if len(data) > 8 and data[:4] == b"\0\0\0\x07" and data[4:8] == b"ssh-":
        return "public"

    def tlv(at: int) -> tuple[int, int, int] | None:
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        return (tag, at, at + size) if at + size <= len(data) else None

    outer = tlv(0)
    if outer is None or outer[0] != 0x30 or len(data) - outer[2] > 3:
        return None
    tags, at = [], outer[1]
    while at < outer[2]:
        part = tlv(at)
        if part is None:
            return None
        tags.append(part[0])
        at = part[2]
    if tags[:1] == [0x02] and (len(tags) >= 9 or tags[1:3] == [0x30, 0x04] or tags[1:2] == [0x04]):
        return "private"
    if tags[:2] == [0x30, 0x03] or tags == [0x02, 0x02] or (len(tags) == 2 and tags == [0x30, 0x04]):
        return "private" if tags == [0x30, 0x04] else "public"
    return None


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\r\n\t" for c in text) == len(text) else None


_B64 = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0x)?((?:[0-9a-fA-F]{2}){12,})(?![0-9A-Za-z])")
_PCT = re.compile(r"(?:[A-Za-z0-9._~-]*%[0-9A-Fa-f]{2}){4,}[A-Za-z0-9._~%-]*")
_ESC = re.compile(r"(?:[^\\\"'\n]{0,40}(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3})){4,}[^\\\"'\n]{0,80}")


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        s = m[0]
        return chr(int(s[2:], 16)) if s[1] in "xu" else chr(int(s[1:], 8))

    return re.sub(r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}", one, text)


#: Classes of RE2 that hold at least what the class of Python holds.
_CLASSES = {sre.CATEGORY_SPACE: r"\s\x0b\x1c-\x1f\x{80}-\x{10ffff}", sre.CATEGORY_DIGIT: r"\d\x{80}-\x{10ffff}", sre.CATEGORY_WORD: r"\w\x{80}-\x{10ffff}", sre.CATEGORY_NOT_SPACE: r"\S"}
#: The letters beyond ASCII that a letter of ASCII matches without regard to case.
_FOLDED_LETTERS = r"\x{130}\x{131}\x{17f}\x{212a}"


def _member(op: object, value: object, negated: bool) -> str:
    if op is sre.CATEGORY:
        return r"\s" if negated and value is sre.CATEGORY_SPACE else _CLASSES[value]
    low, high = (value, value) if op is sre.LITERAL else value
    return rf"\x{{{low:x}}}-\x{{{high:x}}}"


def _wider(tree: object, flags: int) -> str:
    """A parsed pattern for RE2 that matches in every text in which the pattern matches: assertions are left out."""
    fold, out = bool(flags & re.I), []
    for op, value in tree:
        if op in (sre.LITERAL, sre.NOT_LITERAL, sre.IN):
            members = value if op is sre.IN else [(sre.LITERAL, value)]
            negated = op is sre.NOT_LITERAL or members[0][0] is sre.NEGATE
            members = [x for x in members if x[0] is not sre.NEGATE]
            inner = "".join(_member(o, v, negated) for o, v in members)
            out.append(f"[^{inner}]" if negated else f"(?i:[{inner}{_FOLDED_LETTERS}])" if fold else f"[{inner}]")
        elif op is sre.ANY:
            out.append("(?s:.)")
        elif op is sre.BRANCH:
            out.append("(?:" + "|".join(_wider(x, flags) for x in value[1]) + ")")
        elif op is sre.SUBPATTERN:
            out.append("(?:" + _wider(value[3], (flags | value[1]) & ~value[2]) + ")")
        elif op is sre.MAX_REPEAT:
            out.append(f"(?:{_wider(value[2], flags)}){{{value[0]},{'' if value[1] is sre.MAXREPEAT else value[1]}}}")
        elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            raise ValueError(f"no wider form of {op}")
    return "".join(out)


def wider(pattern: re.Pattern) -> str:
    """A pattern for RE2 that matches in every text in which ``pattern`` matches, for prefilters in linear time."""
    return _wider(sre_parser.parse(pattern.pattern, pattern.flags), pattern.flags)


#: Each pattern from which a hit can come with its prefilter.
_FILTERS = {p: wider(p) for p in (_PEM, _ASSIGN, _LOGIN, _SQL, _XML, _URL, _CURL, _HEADER, _QUERY, _OPTION, _CONN, _ENV, _LINE, _FOLDED, _NOTE, _TOKEN, _B64, _HEX, _PCT, _ESC)}
_ALL = frozenset(_FILTERS)


def _layers(text: str, may: frozenset[re.Pattern] = _ALL) -> Iterator[tuple[int, int, bytes | str]]:
    """Encoded literals of a text with what they decode to. Decoding always shortens, so that recursion ends."""
    for m in _B64.finditer(text) if _B64 in may else ():
        raw = m[0].rstrip("=").replace("-", "+").replace("_", "/")
        try:
            yield m.start(), m.end(), base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass
    for m in _HEX.finditer(text) if _HEX in may else ():
        yield m.start(1), m.end(1), bytes.fromhex(m[1])
    for m in _PCT.finditer(text) if _PCT in may else ():
        yield m.start(), m.end(), unquote(m[0], errors="replace")
    for m in _ESC.finditer(text) if _ESC in may else ():
        yield m.start(), m.end(), _unescape(m[0])


def _grow(text: str, end: int) -> int:
    """The end of a literal that goes on in adjoining pieces."""
    while (m := _PIECE.match(text, end)) is not None:
        stop = re.compile(r"[^\"'`\n]*").match(text, m.end())
        if stop is None or stop.end() >= len(text) or text[stop.end()] not in "\"'`":
            break
        end = stop.end()
    return end


def _key_end(text: str, at: int, limit: int) -> int:
    """The end of the last consecutive line or piece of a key without END that begins at ``at``; ``at`` if there is none.

    A short line belongs to the key only as its last one: where the text ends, or if it does not read like a word.
    """
    end = at
    while True:
        between = _BETWEEN.match(text, end, limit)
        line = _KEY_LINE.match(text, between.end(), limit)
        gap = re.sub(r"[bfru](?=[\"'])", "", between[0])
        if line is None or (re.search(r"[\"'`]", gap.rstrip("\"'`")) and gap[-1] not in "\"'`"):
            return end
        if len(line[0]) < 16:
            odd = re.search(r"[0-9+/=]|[a-z][A-Z]", line[0]) or not text[line.end() : limit].strip(" \t\r\n\"'`\\")
            return line.end() if odd and end > at else end
        end = line.end()


def _direct(text: str, prose: bool, may: frozenset[re.Pattern] = _ALL) -> Iterator[Hit]:
    for m in _PEM.finditer(text) if _PEM in may else ():
        following = _BEGIN.search(text, m.end())
        limit = following.start() if following else len(text)
        end = _PEM_END.search(text, m.end(), limit)
        stop = end.end() if end else _key_end(text, m.end(), limit)
        if sum(map(len, _BODY.findall(text, m.end(), end.start() if end else stop))) >= 24:
            yield Hit(m.start(), stop, "private_key")
    for pattern, kind in ((_ASSIGN, "secret"), (_LOGIN, "password"), (_SQL, "password")):
        for m in pattern.finditer(text) if pattern in may else ():
            group = next(i for i in (1, 2, 3) if m[i] is not None)
            end = m.end(group)
            whole = _grow(text, end)
            value = m[group] if whole == end else re.sub(_PIECE, "", text[m.start(group) : whole])
            if usable(value, True):
                yield Hit(m.start(group), whole, kind)
    for m in _XML.finditer(text) if _XML in may else ():
        if usable(m[1], True):
            yield Hit(m.start(1), m.end(1), "secret")
    for m in _URL.finditer(text) if _URL in may else ():
        if usable(m[1], True) and not m[1].isdigit():
            yield Hit(m.start(1), m.end(1), "password")
    for m in _CURL.finditer(text) if _CURL in may else ():
        if usable(m[1], True):
            yield Hit(m.start(1), m.end(1), "password")
    for m in _HEADER.finditer(text) if _HEADER in may else ():
        value = m[3]
        if (m[1] or "").lower() == "basic":
            raw = value.rstrip("=")
            try:
                pair = _printable(base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True))
            except (binascii.Error, ValueError):
                pair = None
            if pair and ":" in pair and not _PLACEHOLDER.search(pair.partition(":")[2]):
                yield Hit(m.start(3), m.end(3), "credential_pair")
        elif random_like(value) and not _PLACEHOLDER.search(value):
            yield Hit(m.start(3), m.end(3), "token")
    for pattern, strong in ((_QUERY, False), (_OPTION, False), (_CONN, True), (_ENV, True), (_FOLDED, True)):
        for m in pattern.finditer(text) if pattern in may else ():
            if usable(m[1], strong) and (strong or random_like(m[1])):
                yield Hit(m.start(1), m.end(1), "secret")
    for m in _LINE.finditer(text) if _LINE in may else ():
        if usable(m[1], False) and not re.fullmatch(r"[\w.]*\.[\w.]*|[A-Za-z_]+\d?", m[1]):
            yield Hit(m.start(1), m.end(1), "secret")
    for m in _TOKEN.finditer(text) if _TOKEN in may else ():
        if not _PLACEHOLDER.search(m[0]):
            yield Hit(m.start(), m.end(), "token")
    notes = [] if _NOTE not in may else [(0, len(text))] if prose else [m.span() for m in _COMMENT.finditer(text)]
    for begin, stop in notes:
        for m in _NOTE.finditer(text, begin, stop):
            value = m[1].rstrip(".,;:") if len(m[1].rstrip(".,;:")) >= 8 else m[1]
            if usable(value, False) and random_like(value.rstrip(".,;:!?")) and "://" not in value and not value.startswith("--"):
                yield Hit(m.start(1), m.start(1) + len(value), "secret")


_PAIR = re.compile(r"[\w.@-]{2,40}:\S{6,}")


def _inside(value: bytes | str) -> str | None:
    """The kind of credential that a decoded literal holds at any depth of encoding, or None."""
    layers = [value]
    while layers:
        value = layers.pop()
        if isinstance(value, bytes):
            kind = der_kind(value)
            if kind == "private":
                return "private_key"
            text = None if kind else _printable(value)
        else:
            text = value
        if text is None:
            continue
        if m := _PAIR.fullmatch(text):
            if usable(m[0].partition(":")[2], True) and not text.startswith(("http", "data:", "urn:", "sha")):
                return "credential_pair"
        for hit in _direct(text, False):
            return hit.kind
        layers += [below for _, _, below in _layers(text)][::-1]
    return None


def _merged(hits: list[Hit]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that hits cover, ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for h in sorted(hits, key=lambda h: h.start):
        if ends and h.start < ends[-1]:
            ends[-1] = max(ends[-1], h.end)
        else:
            starts.append(h.start), ends.append(h.end)
    return starts, ends


def scan(text: str, prose: bool = False, may: frozenset[re.Pattern] = _ALL) -> list[Hit]:
    """Credentials of a text in order, none overlapping another; of two that overlap the one that begins first stays.

    ``may``: the patterns that can match in the text, if that is known.
    """
    hits = list(_direct(text, prose, may))
    starts, ends = _merged(hits)
    for start, end, value in _layers(text, may):
        at = bisect_left(starts, end) - 1
        if at >= 0 and ends[at] > start:
            continue
        before = text[max(0, start - 24) : start]
        if re.search(r"(?:base64,|sha\d{3}-|PUBLIC KEY-----\s*)$", before):
            continue
        if kind := _inside(value):
            hits.append(Hit(start, end, kind))
    hits.sort(key=lambda h: (h.start, -h.end))
    out: list[Hit] = []
    for h in hits:
        if out and h.start < out[-1].end:
            continue
        out.append(h)
    return out


def redact(text: str, prose: bool = False, may: frozenset[re.Pattern] = _ALL) -> str:
    """The text with each credential replaced by ``[REDACTED_KIND]``: quotes, names and line structure around it stay."""
    out, at = [], 0
    for h in scan(text, prose, may):
        out += [text[at : h.start], f"[REDACTED_{h.kind.upper()}]"]
        at = h.end
    return "".join([*out, text[at:]])


def _contexts(column: pa.Array) -> list[frozenset[re.Pattern]]:
    """For each text the patterns that can match in it; none for a null."""
    may: list[list[re.Pattern]] = [[] for _ in range(len(column))]
    for pattern, wider in _FILTERS.items():
        for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(column, wider), False)).to_pylist():
            may[i].append(pattern)
    return [frozenset(x) for x in may]


def _suspects(column: pa.Array) -> list[bool]:
    return [bool(x) for x in _contexts(column)]


def _columns(chunks: DataFrame) -> DataFrame:
    return chunks.selectExpr("chunk_id", "text", "map_keys(metadata) as mkeys", "map_values(metadata) as mvalues")


def found(chunks: DataFrame) -> DataFrame:
    """``chunk_id, field, start_char`` of each credential in ``text`` or in a value of ``metadata``.

    Null and empty texts, null maps and null values hold none. A chunk that was delivered twice counts once. Scanning
    is a narrow map; only the few result rows are shuffled, to make them distinct.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fields, starts = [], [], []
            chunk_ids = batch.column(0)
            texts = batch.column(1)
            for i, may in enumerate(_contexts(texts)):
                if may:
                    for h in scan(texts[i].as_py(), False, may):
                        ids.append(chunk_ids[i].as_py()), fields.append("text"), starts.append(h.start)
            keys, values = batch.column(2), batch.column(3)
            flat, owner = values.flatten(), pc.list_parent_indices(values)
            flat_keys = keys.flatten()
            for j, may in enumerate(_contexts(flat)):
                if may:
                    for h in scan(flat[j].as_py(), True, may):
                        ids.append(chunk_ids[owner[j].as_py()].as_py()), fields.append(flat_keys[j].as_py()), starts.append(h.start)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fields, pa.string()), pa.array(starts, pa.int32())], names=["chunk_id", "field", "start_char"])

    return spread(_columns(chunks), "chunk_id").mapInArrow(run, "chunk_id bigint, field string, start_char int").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """``chunk_id, text, metadata`` of every row with only the credentials replaced; a null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, values = batch.column(1), batch.column(2), batch.column(3)
            new = texts
            if any(contexts := _contexts(texts)):
                new = pa.array([redact(t.as_py(), False, may) if may else t.as_py() for t, may in zip(texts, contexts, strict=True)], pa.string())
            flat = values.flatten()
            clean = pa.array([redact(v.as_py(), True, may) if may else v.as_py() for v, may in zip(flat, _contexts(flat), strict=True)], pa.string())
            offsets, position = [], 0
            for size in pc.list_value_length(values).to_pylist():
                offsets.append(None if size is None else position)
                position += size or 0
            lists = pa.ListArray.from_arrays(pa.array([*offsets, position], pa.int32()), clean)
            yield pa.RecordBatch.from_arrays([batch.column(0), new, keys, lists], names=["chunk_id", "text", "mkeys", "mvalues"])

    out = spread(_columns(chunks), "chunk_id").mapInArrow(run, "chunk_id bigint, text string, mkeys array<string>, mvalues array<string>")
    return out.selectExpr("chunk_id", "text", "map_from_arrays(mkeys, mvalues) as metadata")
