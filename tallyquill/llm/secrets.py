"""Secret scans: three base patterns and assignment-aware lexing."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyquill.llm.common import text_of
from tallyquill.shipping import ship

#: The base patterns. ASCII alone decides about case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "named")

#: How much the words of a target's name say that it holds a secret.
NAME_WORDS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "pass": 2.0, "secret": 3.0, "secrets": 3.0, "token": 2.5,
    "apikey": 3.0, "credential": 3.0, "credentials": 3.0, "bearer": 2.0, "private": 1.5, "signing": 1.5, "encryption": 1.5,
    "access": 1.0, "auth": 1.5, "api": 1.0, "key": 1.5, "client": 0.5, "salt": 1.0, "pin": 1.0, "dsn": 1.0, "webhook": 1.0,
}
#: Whole values that stand in for a secret, and words by which a value with blanks is a sentence.
NOT_SECRET = frozenset("true false null none undefined changeme example placeholder redacted".split())
PROSE = frozenset("a an the your you is are be must should to of for and or not no enter please invalid missing required use see this that with from when if".split())
#: Attributes whose value names what the attribute ``value`` beside it sets.
KEYS, VALUES = ("key", "name", "id"), ("value", "val", "content")
#: Score from which a literal counts: what its name says, plus half its entropy a character.
LEAST_SCORE = 4.0
LEAST_LITERAL = 6

#: Without one of these no name in a text can say that it holds a secret.
_SENSITIVE = re.compile("pass|pwd|secret|token|key|credential|bearer|private|signing|encryption|auth|salt|pin|dsn|webhook|client|api", re.I)
#: Tokens of source and configuration syntax.
_TOKEN = re.compile(
    r"""
    (?P<triple>(?:\b[rRbBuUfF]{1,2})?(?P<tq>\"{3}|'{3}))
  | (?P<heredoc><<[-~]?[ \t]*(?P<hq>["']?)(?P<h>[A-Za-z_]\w*)(?P=hq))
  | (?P<string>(?:\b[rRbBuUfF]{1,2}(?=["'])|(?<!\w))(?P<sq>["'`]))
  | (?P<comment>(?<![\w:/"'])//|/\*|(?<![\w&])\#(?![{\w])|\#(?=[ ])|(?<![\w-])--(?=[ ]))
  | (?P<element><(?P<e>[A-Za-z_][\w.:-]*)>(?P<ev>[^<>\s][^<>]*)</(?P=e)\s*>)
  | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
  | (?P<compare>[=!<>]==?|[<>]=|::)
  | (?P<sign>=>|:=|\?=|=|:)
  | (?P<join>\+=?|\.\.?|&)
  | (?P<open>[(\[{])
  | (?P<close>[)\]}])
  | (?P<skip>[ \t\r\f]+|\\\r?\n)
  | (?P<line>\n)
  | (?P<other>.)
    """,
    re.X | re.S | re.A,
)
_BARE = re.compile(r"[^\s\"'`]+")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[ \t]*\r?\n")
#: What follows the quotes that open a string; some strings go over lines.
_REST = {
    '"': re.compile(r'((?:\\.|[^"\\\n])*)"', re.S),
    "'": re.compile(r"((?:\\.|[^'\\\n])*)'", re.S),
    "`": re.compile(r"((?:\\.|[^`\\])*)`", re.S),
    '"' * 3: re.compile(r'((?:\\.|[^\\])*?)"{3}', re.S),
    "'" * 3: re.compile(r"((?:\\.|[^\\])*?)'{3}", re.S),
}
_NAMED_IN = re.compile(r"\$\{([A-Za-z_][\w.]*)\}|\$([A-Za-z_]\w*)|\#\{([A-Za-z_]\w*)\}|%\(([A-Za-z_]\w*)\)s|\{([A-Za-z_][\w.]*)\}")
_CODE = re.compile(r"[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)+\Z")
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\Z", re.A)
_KEY = re.compile(r"[\w .\-]+\Z")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY")
#: Words that may stand before a name at the beginning of a line of configuration.
_LEADS = ("", "export", "set", "-", "ENV", "ARG", "setenv", "local", "declare", "-e")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    return sum(NAME_WORDS.get(w, 0.0) for w in set(words)) if words else 0.0


#: Letters of a value's beginning that tell a placeholder.
HEAD = 16


def stands_in(length: int, letters: Counter, head: str, tail: str) -> bool:
    """Whether a value is a placeholder: by its letters and both of its ends, however long it is."""
    low = head.lower()
    return (
        length <= HEAD and low in NOT_SECRET
        or letters.keys() <= {"x", "X"} or letters.keys() <= {"*"}
        or head[:1] == "<" and tail[-1:] == ">" or head[:2] == "${" and tail[-1:] == "}" or head[:2] == "{{" and tail == "}}"
        or low[:5] in ("your_", "your-")
    )


def literal_score(name: str, length: int, letters: Counter, head: str, tail: str, prose: bool) -> float:
    """What the name says plus half the value's entropy a character; 0 for what can't be a secret."""
    said = name_score(name)
    if said < 2 or length < LEAST_LITERAL or prose or stands_in(length, letters, head, tail):
        return 0.0
    return said - sum(n / length * math.log2(n / length) for n in letters.values()) / 2


class Source:
    """Name-literal pairs of a text in source or configuration syntax.

    ``pairs`` has (target's name, place, terms, whether it binds a constant); a term is a literal, (start,
    end), the name of a constant, or (start, end, name): a constant if one of this name is bound, else a
    literal. Literals are strings, triple-quoted strings, here-documents, YAML
    blocks, element contents, and unquoted values where a line of configuration begins with the name.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.pairs: list[tuple[str, int, list, bool]] = []
        self.lines: dict[str, list[int]] | None = None
        self.tokens = self.lex()
        self.read()

    def lex(self) -> list[tuple[str, int, int, int, int]]:
        """(kind, start, end, and for literals the content's start and end)."""
        out, at, text = [], 0, self.text
        open_until = dict.fromkeys(_REST, 0)  # up to where quotes are known to stay open
        line_end = -1
        while at < len(text):
            m = _TOKEN.match(text, at)
            a, b = m.span()
            kind = next((k for k in ("triple", "heredoc", "string", "element") if m[k] is not None), m.lastgroup)
            inner = (a, b)
            if line_end < b and kind in ("heredoc", "string"):
                line_end = text.find("\n", b)
                line_end = len(text) if line_end < 0 else line_end
            if kind in ("triple", "string"):
                quotes = m["tq"] or m["sq"]
                rest = None if a < open_until[quotes] else _REST[quotes].match(text, b)
                if rest:
                    inner, b = rest.span(1), rest.end()
                else:
                    open_until[quotes] = max(open_until[quotes], line_end if quotes in ("'", '"') else len(text))
                    kind, b = "other", b if kind == "string" else b - 2
            elif kind == "heredoc":
                end = self.line_of(m["h"], line_end + 1)
                if end is None:
                    kind, b = "other", a + 2
                else:
                    kind, inner, b = "triple", (line_end + 1, max(line_end + 1, end - 1)), end + len(m["h"])
            elif kind == "element":
                self.pairs.append((m["e"], a, [m.span("ev")], False))
            if kind not in ("skip", "other") or kind == "other" and text[a:b] in ",;*?":
                out.append((kind, a, b, *inner))
            at = b
            if kind == "sign" and text[a] == ":" and (block := _BLOCK.match(text, b)):
                found = self.block(a, block.end())
                if found:
                    out.append(("triple", found[0], found[1], *found))
                    at = found[1]
        return out

    def line_of(self, word: str, after: int) -> int | None:
        """The start of the first line from ``after`` on that is this word alone."""
        if self.lines is None:
            self.lines, at = {}, 0
            for line in self.text.split("\n"):
                if line.strip().isidentifier():
                    self.lines.setdefault(line.strip(), []).append(at + len(line) - len(line.lstrip()))
                at += len(line) + 1
        places = self.lines.get(word, [])
        i = bisect_left(places, after)
        return places[i] if i < len(places) else None

    def block(self, sign: int, start: int) -> tuple[int, int] | None:
        """The lines from ``start`` on that are further in than the sign's line."""
        text = self.text
        line = text.rfind("\n", 0, sign) + 1
        depth = len(text[line:sign]) - len(text[line:sign].lstrip(" -"))
        at = end = start
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            said = text[at:stop].strip()
            if said:
                if len(text[at:stop]) - len(text[at:stop].lstrip(" ")) <= depth:
                    break
                end = stop
            at = stop + 1
        content = start + len(text[start:end]) - len(text[start:end].lstrip())
        return (content, end) if end > start else None

    def read(self) -> None:
        tokens, i, commented, begun = self.tokens, 0, False, 0
        while i < len(tokens):
            kind, a, b, x, y = tokens[i]
            if kind == "line":
                commented, begun = False, i + 1
            elif kind == "comment":
                commented = True
                begun = i + 1
            elif kind == "sign" and (names := self.targets(i, begun)):
                i = max(i, self.values(names, i, not commented) - 1)
            elif kind == "sign":
                name, head = self.target(i, begun)
                if name:
                    terms, stop = self.value(i + 1, head)
                    if terms:
                        self.pairs.append((name, a, terms, not commented))
                        i = max(i, stop - 1)
            elif kind == "open" and self.text[a] == "(" and i + 3 < len(tokens) and [t[0] for t in tokens[i + 1 : i + 4]] == ["string", "other", "string"] and self.text[tokens[i + 2][1]] == ",":
                name = self.text[tokens[i + 1][3] : tokens[i + 1][4]]  # define("NAME", "literal")
                if _KEY.match(name):
                    self.pairs.append((name, a, [(tokens[i + 3][3], tokens[i + 3][4])], not commented))
            i += 1

    def targets(self, i: int, begun: int) -> list[str]:
        """The names of ``a, b = ...``, the line's first tokens; none if it isn't of this form."""
        tokens, text = self.tokens, self.text
        if text[tokens[i][1] : tokens[i][2]] not in ("=", ":=") or i - begun < 3 or (i - begun) % 2 == 0:
            return []
        names, j = [], i - 1
        while j >= begun and tokens[j][0] == "name":
            names.append(text[tokens[j][1] : tokens[j][2]])
            if j == begun:
                return names[::-1]
            if tokens[j - 1][0] != "other" or text[tokens[j - 1][1]] != ",":
                break
            j -= 2
        return []

    def values(self, names: list[str], i: int, binds: bool) -> int:
        """Pairs the names with the expressions behind token ``i``, and tells where these end."""
        tokens, at, place = self.tokens, self.tokens[i][1], i + 1
        for n, name in enumerate(names):
            terms, stop = self.value(place, False)
            if terms:
                self.pairs.append((name, at, terms, binds))
            if n == len(names) - 1 or stop >= len(tokens) or tokens[stop][0] != "other" or self.text[tokens[stop][1]] != ",":
                return stop
            place = stop + 1
        return place

    def target(self, i: int, begun: int) -> tuple[str | None, bool]:
        """The name that a sign assigns to, and whether nothing but it stands before the sign on its line."""
        tokens, text, j = self.tokens, self.text, i - 1
        said = lambda t: text[t[3] : t[4]]
        if j >= begun and tokens[j][0] == "other" and text[tokens[j][1]] == "?":
            j -= 1
        if j < begun:
            return None, False
        if tokens[j][0] == "close" and text[tokens[j][1]] == "]" and j - 1 >= begun and tokens[j - 1][0] in ("string", "name"):
            return said(tokens[j - 1]), False
        if j - 2 >= begun and text[tokens[i][1] : tokens[i][2]] == "=" and tokens[j][0] == "name" and tokens[j - 1][0] == "sign" and tokens[j - 2][0] == "name":
            j -= 2  # name: type = value
        if tokens[j][0] == "string" and _KEY.match(said(tokens[j])) or tokens[j][0] == "name":
            line = tokens[begun][1] if begun < len(tokens) else 0
            lead = text[line : tokens[j][1]].strip() if tokens[j][1] - line < 40 else "?"
            return self.key_before(j) or said(tokens[j]), lead in _LEADS
        return None, False

    def key_before(self, j: int) -> str | None:
        """What ``value`` at token ``j`` is the value of: the key, name or id that an attribute or field before it gives."""
        tokens, text = self.tokens, self.text
        if text[tokens[j][3] : tokens[j][4]] not in VALUES:
            return None
        j -= 1
        while j >= 0 and (tokens[j][0] == "line" or tokens[j][0] == "other" and text[tokens[j][1]] == ","):
            j -= 1
        if j < 2 or tokens[j][0] not in ("string", "name") or tokens[j - 1][0] != "sign" or tokens[j - 2][0] not in ("string", "name"):
            return None
        key = text[tokens[j][3] : tokens[j][4]]
        return key if text[tokens[j - 2][3] : tokens[j - 2][4]] in KEYS and _KEY.match(key) else None

    def arguments(self, i: int) -> tuple[list, int] | None:
        """The literals and constants between the bracket at token ``i`` and its end, and the token behind; None for other things."""
        tokens, text, terms, depth = self.tokens, self.text, [], 0
        while i < len(tokens):
            kind, a, b, x, y = tokens[i]
            if kind == "open":
                if depth and tokens[i - 1][0] == "name":
                    return None
                depth += 1
            elif kind == "close":
                depth -= 1
                if not depth:
                    return terms, i + 1
            elif kind in ("string", "triple"):
                terms.append((x, y))
            elif kind == "name":
                terms.append(text[a:b])
            elif kind == "sign" and terms and isinstance(terms[-1], str):
                terms.pop()  # an argument's name
            elif kind not in ("line", "join") and not (kind == "other" and text[a] == ","):
                return None
            i += 1
        return None

    def value(self, i: int, alone: bool) -> tuple[list, int]:
        """The terms of the expression from token ``i`` on, and where it ends."""
        tokens, text, terms, joined, wrapped = self.tokens, self.text, [], True, False
        if i < len(tokens) and tokens[i][0] == "open" and text[tokens[i][1]] == "(":
            i, wrapped = i + 1, True
        first = i
        while i < len(tokens):
            kind, a, b, x, y = tokens[i]
            if kind in ("string", "triple"):  # adjacent literals are one
                if not joined and kind == "triple":
                    break
                terms.append((x, y))
                joined = False
            elif kind == "name" and joined:
                called = i + 1 < len(tokens) and tokens[i + 1][0] == "open" and tokens[i + 1][1] == b and text[b] != "{"
                if called and text[a:b] in ("join", "format") and i - 2 >= first and tokens[i - 2][0] in ("string", "triple") and text[tokens[i - 1][1]] == ".":
                    given = self.arguments(i + 1)  # of a literal's method that puts others into it
                    if given is None:
                        return [], first
                    terms += given[0]
                    i, joined = given[1], False
                    continue
                if called:
                    return [], first
                if alone and i == first and not wrapped:
                    if first and text[tokens[first - 1][2] : a].strip():  # figures before letters
                        return self.bare(tokens[first - 1][2], first)
                    end = _BARE.match(text, a).end()
                    if end > b or i + 1 == len(tokens) or tokens[i + 1][0] in ("line", "comment"):
                        return self.bare(a, first)
                terms.append(text[a:b])
                joined = False
            elif kind == "join":
                joined = True
            elif kind == "line" and (wrapped or joined and i > first):
                pass
            elif alone and i == first and not wrapped and kind not in ("line", "comment"):
                return self.bare(a, first)
            else:
                break
            i += 1
        if alone and not terms and not wrapped and first > 0:
            return self.bare(tokens[first - 1][2], first)
        return terms, i

    def bare(self, at: int, first: int) -> tuple[list, int]:
        """An unquoted value: all up to white space or a quote, but for a separator at its end."""
        text = self.text
        while at < len(text) and text[at] in " \t":
            at += 1
        m = _BARE.match(text, at)
        if not m:
            return [], first
        a, b = m.span()
        while b > a and text[b - 1] in ",;":
            b -= 1
        said = text[a:b]
        if said[:1] in "([{<" or re.search(r"\w\(", said):
            return [], first
        stop = first
        while stop < len(self.tokens) and self.tokens[stop][1] < b:
            stop += 1
        if _CODE.match(said) and not any(c.isdigit() for c in said):  # a member of something; a constant, if it is bound
            return [said], stop
        return [(a, b, said) if _NAME.match(said) else (a, b)], stop

    def found(self) -> set[tuple[int, int]]:
        """The literals that make up values of targets whose names say that they are secret."""
        bound: dict[str, list[tuple[int, int]]] = {}
        for n, (name, at, _, binds) in enumerate(self.pairs):
            if binds:
                bound.setdefault(name, []).append((at, n))
        for some in bound.values():
            some.sort()

        def constant(name: str, at: int) -> int | None:
            """The pair that a name stands for: the last one before, else the first one after."""
            some = bound.get(name)
            if not some:
                return None
            i = bisect_left(some, (at, -1))
            return some[i - 1][1] if i else some[0][1]

        parts: list[list] = []  # of each pair its literals and the pairs of its constants
        for n, (_, at, terms, _) in enumerate(self.pairs):
            mine: list = []
            for t in terms:
                if isinstance(t, str) or len(t) == 3:
                    other = constant(t if isinstance(t, str) else t[2], at)
                    if other is not None and other != n:
                        mine.append(other)
                        continue
                    if isinstance(t, str):
                        continue
                    t = t[:2]
                mine.append(t)
                for m in _NAMED_IN.finditer(self.text, *t):
                    other = constant(next(g for g in m.groups() if g), at)
                    if other is not None and other != n:
                        mine.append(other)
            parts.append(mine)
        told: dict[int, tuple[int, Counter, str, str, bool]] = {}
        secret: set[int] = set()
        for n, (name, *_) in enumerate(self.pairs):
            if name_score(name) >= 2 and literal_score(name, *self.told_of(n, parts, told)) >= LEAST_SCORE:
                secret.add(n)
        spans, todo = set(), list(secret)
        while todo:
            for p in parts[todo.pop()]:
                if isinstance(p, tuple):
                    if p[1] > p[0]:
                        spans.add(p)
                elif p not in secret:
                    secret.add(p)
                    todo.append(p)
        return spans

    def told_of(self, n: int, parts: list[list], told: dict) -> tuple[int, Counter, str, str, bool]:
        """Length, letters, both ends, and whether it has a sentence's words, of a pair's value; constants in it count once each."""
        todo = [n]
        open_: set[int] = set()
        while todo:
            at = todo[-1]
            if at in told:
                todo.pop()
                continue
            need = [p for p in parts[at] if isinstance(p, int) and p not in told and p not in open_] if at not in open_ else []
            if need:
                open_.add(at)
                todo += need
                continue
            length, letters, head, tail, prose = 0, Counter(), "", "", False
            for p in parts[at]:
                if isinstance(p, tuple):
                    value = _NAMED_IN.sub("", self.text[p[0] : p[1]]) if any(isinstance(q, int) for q in parts[at]) else self.text[p[0] : p[1]]
                    more_prose = False
                    if not _PEM.match(value.lstrip()):
                        lines = [x.strip() for x in value.strip().split("\n")]
                        more_prose = any(" " in x or "\t" in x for x in lines) and not PROSE.isdisjoint(value.lower().split())
                        value = "".join(lines)
                    more = len(value), Counter(value), value[:HEAD], value[-2:], more_prose
                else:
                    more = told.get(p, (0, Counter(), "", "", False))
                length, letters = length + more[0], letters + more[1]
                head, tail, prose = (head + more[2])[:HEAD], (tail + more[3])[-2:], prose or more[4]
            told[at] = length, letters, head, tail, prose
            todo.pop()
        return told[n]


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added spans as (start, kind's place in ``KINDS``, end)."""
    base = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    if not _SENSITIVE.search(text) or not any(c in text for c in "=:<,"):
        return base, []
    upto = list(itertools.accumulate((e for _, _, e in base), max))
    starts = [a for a, _, _ in base]
    inside = lambda a, b: (i := bisect_right(starts, a)) > 0 and upto[i - 1] >= b
    return base, sorted((a, 3, b) for a, b in Source(text).found() if not inside(a, b))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of (kind, start, end, base), by start, then kind.

    Offsets are code points, end exclusive. ``base`` marks spans of the three base patterns; kind
    ``named`` are whole literals bound, directly or through constants, to names that say they are
    secret, unless they lie within a base span.

    Null text counts as empty, which has no spans. Rows are independent, so ties and repeated rows
    need no rule. Long texts are scanned whole. An empty table gives no rows. Other columns are not
    read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([rows.schema["id"], T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base, more = scan(text)
                out.append([{"kind": KINDS[k], "start": a, "end": e, "base": k < 3} for a, k, e in sorted(base + more)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, arrow)], ["id", "spans"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    n_of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(n_of, KINDS),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def brute_base(text: str | None) -> tuple[list[tuple[int, int, int]], str]:
    """The base spans by the plain patterns, for tests."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(found), hashlib.sha256(said(sorted(found)).encode()).hexdigest()
