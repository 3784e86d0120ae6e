"""Secret scans: assignment-aware lexing of source and configuration syntax.

A text is lexed: strings (both quotes and backticks, triple, raw, formatted, with escapes), comments, tags, brackets, calls
and signs. Signs (``=``, ``:``, ``:=``, ``=>``) with what stands before them, the key and value of a call or a tag, elements and YAML
blocks make name-literal pairs: ``name = "x"``, ``name: type = "x"``, ``"name": "x"``, ``conf["name"] = "x"``, ``set("name", "x")``,
``<name>x</name>``, ``<add key="name" value="x"/>``. Concatenations are folded, over lines in brackets, formatted strings
are cut into their literals and names, constants are propagated through names that refer
to earlier ones, and each literal is scored by how sensitive the names are that it reaches, by its
length and by the spread of its characters. What stands in a comment or within another string is no assignment, unless the string is
itself written as one, such as JSON in a string. Names, values and their number have no bound: a constant is
held as references to what it is joined from, with its characters counted, so it is never written out. The contract's plain patterns (assign, access, hex) are
always kept, wherever they stand; literals that the lexer adds come as spans of kind ``literal``.

Edge cases: null text counts as empty and has no span. Equal texts give equal results, row by row.
Offsets are code points, end exclusive. A quote or bracket that is never closed is a plain character. Every step is linear in the text (and in the number of
different characters of a joined constant): what is not closed is looked for once, a name is looked for
between a sign and the one before, and texts without a sign, tag or call are not lexed at all. ``scan`` writes the columns named in SCHEMA,
in place of columns of these names, and leaves all others alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The contract's base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")

#: How much each part of a name speaks for a secret; parts are split at case changes, digits and punctuation.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.6, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.5, "authorization": 0.7, "bearer": 0.8, "key": 0.4, "api": 0.3, "access": 0.3, "private": 0.4,
    "signing": 0.4, "encryption": 0.4, "client": 0.1, "session": 0.2, "webhook": 0.3, "salt": 0.4,
}
#: Parts that make a sensitive word harmless (``token_count``, ``password_hint_url``).
HARMLESS = {"count", "size", "length", "limit", "name", "type", "url", "uri", "path", "field", "label", "hint", "index", "id", "regex", "pattern", "public", "max", "min", "expiry", "ttl"}
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*+|\.+|change_?me|example.*|your[-_ ].*|<.*>|\$\{.*\}|%\(.*|none|null|true|false|todo|dummy|test|placeholder|redacted)$")
THRESHOLD = 0.75
MIN_LENGTH = 8
#: Of a joined constant so many characters of either end are kept as they are, more than any placeholder's fixed part has.
ENDS = 32

#: Where the lexer stops on its way through a text.
STOP = re.compile(
    r"""(?P<comment>(?<!\S)\#[\s!][^\n]*|(?<![:\w/])//[^\n]*)|(?P<remark>/\*|<!--)|(?P<string>\"\"\"|\'\'\'|["'`])"""
    r"""|(?P<tag><(?P<element>[A-Za-z_][\w.:-]*+)(?P<attributes>(?:\s++[\w.:-]++\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'))*+)\s*+(?P<empty>/?)>)"""
    r"""|(?P<call>\((?=\s*+["']))|(?P<sign>:=|=>|(?<![=!<>])=(?![=~])|:(?![:/]))""",
    re.ASCII,
)
#: Whether there is anything to lex.
ANY = re.compile(r"[=:]|</|\(\s*+[\"']")
#: A name from its sign leftwards.
NAME_BACK = re.compile(r"""[\x20\t]*+([\w.$-]*+(?<=[A-Za-z_$]))""", re.ASCII)
INDEXED = re.compile(r"\[[\x20\t]*([\w.$-]+)[\x20\t]*\][\x20\t]*\Z", re.ASCII)
ANNOTATION = re.compile(r"[\x20\t]*[A-Za-z_][\w.]*(?:\[[\w., |\[\]]*\])?(?:[\x20\t]*\|[\x20\t]*\w+)*[\x20\t]*=(?![=~>])", re.ASCII)
ATTRIBUTE = re.compile(r"""([\w.:-]+)\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""", re.ASCII)
LINE = {'"': re.compile(r'(?:[^"\\\n]|\\.)*+"', re.DOTALL), "'": re.compile(r"(?:[^'\\\n]|\\.)*+'", re.DOTALL)}
BARE = re.compile(r"[A-Za-z0-9+/_.=~$@!%^&*-]+")
BLANKS, GAP = re.compile(r"[\x20\t]*+(?:\\\n[\x20\t]*+)?"), re.compile(r"\s*+")
JOIN = re.compile(r"\+(?!=)|\.\.|\.(?=[\x20\t\n]*[\"'`$A-Za-z_(])|&(?!&)")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[\x20\t]*\n")
#: A string with no quote, bracket or line of its own is just a value, whatever signs it has.
SPELLED = re.compile(r"[^\s\"'`{}\[\]<>]*+\Z|[^\"'`{}\[\]<>=\n]*+\Z")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w.$]*\Z", re.ASCII)
HOLE = re.compile(r"\$?\{([^{}]*)\}")
#: Calls that hand their argument on, whatever module they stand in.
WRAPPERS = frozenset("str string bytes bytearray b64decode b64encode fromhex unhexlify decode encode atob btoa text secret secretstr securestring quote trim strip of new".split())
KEYS, VALUES = ("key", "name", "id", "property", "variable"), ("value", "content", "default")


def name_parts(name: str) -> list[str]:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return [p.lower() for p in re.split(r"[^A-Za-z]+", spaced) if p]


def sensitivity(name: str) -> float:
    """0 to 1 by the parts of a name; joined neighbours (api+key) count as one part too."""
    parts = name_parts(name)
    if any(p in HARMLESS for p in parts[-1:]):
        return 0.0
    parts = [p if p in SENSITIVE or not p.endswith("s") else p[:-1] for p in parts]  # passwords, tokens
    both = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return min(1.0, max((SENSITIVE.get(b, 0.0) for b in both), default=0.0) + sum(sorted((SENSITIVE.get(p, 0.0) for p in parts), reverse=True)[:2]))


def entropy(counts: Counter) -> float:
    """Bits for each character."""
    n = counts.total()
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


class Value:
    """A constant: its own literal's span, or the values it is joined from, shared and never written out."""

    __slots__ = ("_counts", "ends", "length", "marked", "parts", "span", "text")

    def __init__(self, span: tuple[int, int] | None, text: str, parts: tuple[Value, ...] = ()):
        self.span, self.text, self.parts, self.marked = span, text, parts, False
        self.length = sum(p.length for p in parts) if parts else len(text)
        self.ends = (text, text)
        self._counts: Counter | None = None
        if parts:
            head = tail = ""
            for p in parts:
                if len(head) >= ENDS:
                    break
                head += p.ends[0][:ENDS]
            for p in reversed(parts):
                if len(tail) >= ENDS:
                    break
                tail = p.ends[1][-ENDS:] + tail
            self.ends = (head[:ENDS], tail[-ENDS:])
            self._counts = sum_counts(parts)

    @staticmethod
    def joined(parts: list[Value]) -> Value:
        return parts[0] if len(parts) == 1 else Value(None, "", tuple(parts))

    def counts(self) -> Counter:
        return self._counts if self._counts is not None else Counter(self.text)

    def outline(self, counts: Counter) -> str:
        """A text that is a placeholder if and only if the whole value is: both ends with every character between them."""
        if not self.parts:
            return self.text
        head, tail = self.ends
        return head + "".join(counts) + tail if self.length > ENDS else head

    def mark(self, found: set[tuple[int, int]]) -> None:
        """Add the spans of all literals it is joined from; what is marked already is not visited again."""
        open_ = [self]
        while open_:
            v = open_.pop()
            if not v.marked:
                v.marked = True
                if v.span:
                    found.add(v.span)
                open_ += v.parts


def sum_counts(parts: tuple[Value, ...]) -> Counter:
    out = Counter()
    for p in parts:
        out.update(p.counts())
    return out


CLASSES = tuple(re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))


def value_score(name: str, value: Value) -> float:
    if value.length < MIN_LENGTH or not (weight := sensitivity(name)):
        return 0.0
    counts = value.counts()
    used = "".join(counts)
    if PLACEHOLDER.match(value.outline(counts)) or re.search(r"\s", used):
        return 0.0
    mixed = sum(bool(p.search(used)) for p in CLASSES) >= 2
    return weight * (0.4 + 0.1 * min(entropy(counts), 4.0) + (0.2 if mixed else 0.0))


Part = tuple[int, int, str, bool]  # start, end, body, and whether it is a name rather than a literal


class Lexer:
    """The (name, parts of its value) of every assignment in a text, in text order."""

    def __init__(self, text: str):
        self.text, self.pairs = text, []
        self._unclosed: set[str] = set()
        self._read(0, len(text))

    def _find(self, mark: str, at: int, end: int) -> int:
        """Where a mark that closes something stands; what is not found once is not looked for again."""
        if mark in self._unclosed:
            return -1
        found = self.text.find(mark, at, end)
        if found < 0 and end == len(self.text):
            self._unclosed.add(mark)
        return found

    def _string(self, at: int, end: int) -> tuple[int, int, int] | None:
        """(body's start, body's end, end) of the string whose quotes start at a place."""
        quote = self.text[at : at + 3] if self.text[at : at + 3] in ('"""', "\'\'\'") else self.text[at]
        start = at + len(quote)
        if quote in LINE:
            m = LINE[quote].match(self.text, start, end)
            return (start, m.end() - 1, m.end()) if m else None
        close = self._find(quote, start, end)
        return None if close < 0 else (start, close, close + len(quote))

    def _nested(self, body: tuple[int, int, int]) -> None:
        """Lex what is written within a string, such as JSON."""
        start, stop, _ = body
        if stop - start > MIN_LENGTH and ANY.search(self.text, start, stop) and not SPELLED.match(self.text, start, stop):
            self._read(start, stop)

    def _formatted(self, at: int) -> bool:
        return self.text[at] == "`" or at > 0 and self.text[at - 1] in "fF" or at > 1 and self.text[at - 1] in "rR" and self.text[at - 2] in "fF"

    def _parts(self, at: int, body: tuple[int, int, int]) -> list[Part]:
        """A string as literals and the names in its holes."""
        start, stop, _ = body
        if not self._formatted(at):
            return [(start, stop, self.text[start:stop], False)] if stop > start else []
        out: list[Part] = []
        for hole in HOLE.finditer(self.text, start, stop):
            if hole.start() > start:
                out.append((start, hole.start(), self.text[start : hole.start()], False))
            said = hole.group(1).split("!")[0].split(":")[0].strip()
            if IDENTIFIER.match(said):
                out.append((hole.start(1), hole.start(1), said, True))
            start = hole.end()
        if stop > start:
            out.append((start, stop, self.text[start:stop], False))
        return out

    def _operand(self, at: int, end: int) -> tuple[list[Part], int] | None:
        """A string or a word; a call's name counts as one only if it hands its argument on, and then has no part of its own."""
        text, quote = self.text, at
        while quote < end and quote - at < 3 and text[quote] in "rRbBuUfF":
            quote += 1
        if quote < end and text[quote] in "\"'`" and (body := self._string(quote, end)):
            self._nested(body)
            return self._parts(quote, body), body[2]
        word = BARE.match(text, at, end)
        if not word:
            return None
        said, after = word.group(0), word.end()
        if IDENTIFIER.match(said):
            if after < end and text[after] == "(":
                return ([], after) if said.lower().rsplit(".", 1)[-1] in WRAPPERS else None
            return [(at, after, said, True)], after
        return [(at, after, said, False)], after

    def _joined(self, at: int, end: int) -> tuple[list[Part], int] | None:
        """The parts of a concatenation, within brackets over lines; None where it holds what no literal is."""
        text, depth = self.text, 0
        out: list[Part] = []
        while True:
            at = (GAP if depth else BLANKS).match(text, at, end).end()
            if at < end and text[at] == "(":
                depth, at = depth + 1, at + 1
                continue
            got = self._operand(at, end)
            if not got:
                return (out, at) if out and not depth else None
            out += got[0]
            stop = after = got[1]
            if not got[0] and text[after : after + 1] == "(":
                at = after
                continue
            while True:
                after = (GAP if depth else BLANKS).match(text, stop, end).end()
                if not depth or text[after : after + 1] != ")" or after >= end:
                    break
                depth, stop = depth - 1, after + 1
            if m := JOIN.match(text, after, end):
                at = GAP.match(text, m.end(), end).end()
            elif after < end and text[after] in "\"'" and text[stop - 1] in "\"'":  # strings side by side
                at = after
            else:
                return None if depth else (out, stop)

    def _block(self, at: int, end: int, indent: int) -> tuple[list[Part], int]:
        """The lines below that stand deeper than their key, as a YAML block has them."""
        out: list[Part] = []
        while at < end:
            stop = self.text.find("\n", at, end)
            stop = end if stop < 0 else stop
            line = self.text[at:stop]
            first = at + len(line) - len(line.lstrip(" "))
            if line.strip():
                if first - at <= indent:
                    break
                last = at + len(line.rstrip())
                out.append((first, last, self.text[first:last], False))
            at = stop + 1
        return out, min(at, end)

    def _value(self, name: str, sign: re.Match, at: int, end: int) -> int:
        """Take the value after a sign; returns where it ends."""
        text = self.text
        names = [name]
        if sign.group(0) == ":" and (typed := ANNOTATION.match(text, at, end)):
            names.append(re.split(r"[^\w.]", typed.group(0).strip())[0])  # in "note: name = x" it is no type
            at = typed.end()
        first = BLANKS.match(text, at, end).end()
        if block := BLOCK.match(text, first, end):
            line = text.rfind("\n", 0, sign.start()) + 1
            parts, after = self._block(block.end(), end, len(text[line : sign.start()]) - len(text[line : sign.start()].lstrip(" -")))
            self._pair(names, parts)
            return after
        if first < end and text[first] == "\n":
            below = GAP.match(text, first, end).end()
            first = below if below < end and text[below] in "\"'`(" else first
        if first < end and text[first] == "[":
            while got := self._joined(GAP.match(text, first + 1, end).end(), end):
                self._pair(names, got[0])
                first = GAP.match(text, got[1], end).end()
                if first >= end or text[first] != ",":
                    return got[1]
            return first
        got = self._joined(first, end)
        if not got:
            return first
        self._pair(names, got[0])
        return got[1]

    def _pair(self, names: list[str], parts: list[Part]) -> None:
        if parts:
            self.pairs += [(name, parts) for name in names]

    def _tag(self, m: re.Match, end: int) -> int:
        """Attributes, key and value attributes of one tag, and the text of an element that holds nothing else."""
        element = m.group("element")
        held = {a.group(1).lower(): a for a in ATTRIBUTE.finditer(self.text, *m.span("attributes"))}
        part = lambda a: [(*a.span(2 if a.group(2) is not None else 3), a.group(2) or a.group(3) or "", False)]
        key = next((part(held[k])[0][2] for k in KEYS if k in held), "")
        for name, a in held.items():
            self._pair([key if key and name in VALUES else name], [x for x in part(a) if x[2]])
        if m.group("empty"):
            return m.end()
        close = self.text.find("<", m.end(), end)
        if close > 0 and self.text.startswith(f"</{element}", close):
            body = self.text[m.end() : close]
            start = m.end() + len(body) - len(body.lstrip())
            if body.strip():
                self._pair([key or element], [(start, start + len(body.strip()), body.strip(), False)])
            return close
        return m.end()

    def _read(self, at: int, end: int) -> None:
        text, last = self.text, None  # last: the string that ended most lately
        before = at
        while m := STOP.search(text, at, end):
            kind, at = m.lastgroup, m.end()
            if kind == "empty":
                kind = "tag"
            if kind == "remark":
                close = self._find("*/" if m.group(0) == "/*" else "-->", at, end)
                at = at if close < 0 else close + 2
            elif kind == "string":
                start = m.start()
                opens = m.group(0) != "'" or start == 0 or not text[start - 1].isalnum() or text[start - 1] in "rRbBuUfF"
                if body := opens and self._string(start, end):
                    self._nested(body)
                    last, at = (start, *body), body[2]
            elif kind == "tag":
                at = self._tag(m, end)
            elif kind == "call":
                at = self._call(GAP.match(text, at, end).end(), end)
            elif kind == "sign":
                name = self._name(m, before, last)
                before = m.end()
                if name:
                    at = max(at, self._value(name, m, at, end))

    def _call(self, at: int, end: int) -> int:
        """The key and the value of a call such as set("name", "value")."""
        key = self._string(at, end)
        if not key:
            return at + 1
        after = GAP.match(self.text, key[2], end).end()
        if after < end and self.text[after] == "," and IDENTIFIER.match(said := self.text[key[0] : key[1]].replace("-", "_")):
            got = self._joined(GAP.match(self.text, after + 1, end).end(), end)
            if got:
                self._pair([said], got[0])
                return got[1]
        return at

    def _name(self, sign: re.Match, before: int, last: tuple[int, int, int, int] | None) -> str:
        """What a sign gives a value to: a word, a string or a subscript right before it."""
        text = self.text
        if last and last[3] <= sign.start() and last[0] >= before:
            between = text[last[3] : sign.start()].strip()
            if not between:
                return text[last[1] : last[2]]
            if between == "]" and text[: last[0]][-1:] == "[":
                return text[last[1] : last[2]]
        left = max(before, text.rfind("\n", before, sign.start()) + 1)
        if inner := INDEXED.search(text, left, sign.start()):
            return inner.group(1)
        found = NAME_BACK.match(text[left : sign.start()][::-1])
        return found.group(1)[::-1] if found else ""


def lexed(text: str) -> list[tuple[int, int]]:
    """Spans of literals whose value reaches a sensitive name, directly or through other names."""
    said = Lexer(text).pairs
    later = {body for _, parts in said for _, _, body, named in parts if named}
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    for name, parts in said:
        if name not in later and not sensitivity(name):
            continue
        held = [known.get(body) if named else None for _, _, body, named in parts]
        # a name that stands for nothing is a literal only where it is bare and has a digit
        own = [h or (Value((s, e), body) if not named or e > s and re.search("[0-9]", body) else None) for h, (s, e, body, named) in zip(held, parts, strict=True)]
        if not (own := [x for x in own if x]):
            continue
        value = Value.joined(own)
        if value_score(name, value) >= THRESHOLD:
            value.mark(found)
        if name in later:
            known[name] = value
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the contract's patterns."""
    spans = []
    low = text.lower() if ("=" in text or ":" in text) else ""
    if low and any(k in low for k in ("passw", "secret", "token", "api")):
        spans += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def in_order(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]), x[2])))


def scan_text(text: str | None) -> tuple[int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    more = [(s, "literal", e) for s, e in lexed(text)] if ANY.search(text) else []
    count = Counter(k for _, k, _ in base)
    digest = hashlib.sha256(in_order(base).encode()).hexdigest()
    return count["assign"], count["access"], count["hex"], digest, in_order(base + more)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_assign, n_access, n_hex, base_sha256 and spans to every row; all other columns stay."""

    @F.pandas_udf(SCHEMA)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for s in batches:
            yield pd.DataFrame([scan_text(x) for x in s], columns=names)

    got = docs.withColumn("_found", scanned(F.col(text)))
    return got.withColumns({c: F.col(f"_found.{c}") for c in (x.split()[0] for x in SCHEMA.split(", "))}).drop("_found")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every found span in the text; overlapping spans become one mark. Null text stays null."""

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if x is None else redact_text(x, mark) for x in s], dtype=object)

    return docs.withColumn(text, redacted(F.col(text)))


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with a mark for each value; names, signs and quotes stay."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    values += [(s, e) for s, kind, e in base_spans(text) if kind != "assign"] + lexed(text)
    out, at = [], 0
    for s, e in sorted(values):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def op3(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text")
