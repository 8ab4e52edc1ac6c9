"""Personal data by a semi-Markov conditional random field over spans.

Certain kinds are found by fixed patterns. Around every place that could be
personal data, a window of tokens is cut, and the field scores whole spans of
up to ``LONGEST`` tokens of it as one of the kinds. A dynamic program over the
ends of spans picks boundaries and kinds jointly. The field is trained here, on
windows of a bounded sample of texts, to agree with the patterns and with
spelled keys; it generalises by shape, and its spans are added where no pattern
has matched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratanet.llm.common import slices, stored, text_of

#: Kinds in the order of results; the first four have fixed patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Fixed values of the contract, with the same matches: numbers begin where no digit stands before them.
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Spelled keys, from which the field learns what secrets look like.
SPELLED = re.compile(r"\bAKIA[0-9A-Z]{16}\b|\b(?:api_?key|secret|token|password|passwd)\s?[=:]\s?\"?[0-9A-Za-z_-]{8,}\"?", re.I)
#: Where a window may begin: tokens without any of these are never part of a span.
SEED = re.compile(r"[0-9@=]|(?i:key|secret|token|password|passwd)\s?:")
TOKEN = re.compile(r"\S+")
#: Tokens of a span at most, and tokens that stand on either side of a seed in its window.
LONGEST = 4
AROUND = 2
#: Tokens of a window at most; a longer run of seeds goes on in the next one.
WINDOW = 64
#: Texts that the field is trained on at most, windows of each, and rounds.
SAMPLE_TEXTS = 400
SAMPLE_WINDOWS = 4
EPOCHS = 6
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ to the left so that long words cost no more than their length."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in EMAIL_NAME:
            begin -= 1
        host = EMAIL_HOST.match(text, at + 1) if begin < at else None
        if host:
            yield begin, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind and place."""
    found: list[Span] = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        values = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(v) <= 3 and int(v or "0") <= 255 for v in values):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of tokens around seeds, as (begin, end) in the text."""
    tokens: list[tuple[int, int]] = []
    last = -AROUND - 1
    recent: list[tuple[int, int]] = []
    for i, m in enumerate(TOKEN.finditer(text)):
        recent = [*recent[-AROUND:], m.span()]
        # A colon may stand by itself behind its key word.
        seed = m[0][0] == ":" or SEED.search(m[0]) is not None
        if tokens and i - last > AROUND and not seed:
            yield tokens
            tokens = []
        elif len(tokens) >= WINDOW:
            yield tokens
            # Any span that goes on beyond the window is whole in the next.
            tokens = tokens[1 - LONGEST :]
        if seed:
            if not tokens:
                tokens = recent[:]
            else:
                tokens.append(m.span())
            last = i
        elif tokens:
            tokens.append(m.span())
    if tokens:
        yield tokens


PARTS = re.compile(r"[0-9]+|[A-Z]+|[a-z]+|\s+|[^0-9A-Za-z\s]")


def features(kind: str, text: str, before: str) -> list[str]:
    """Features of a whole candidate span and of what stands before it."""
    return [f"{kind}|{f}" for f in shape(text, before)]


def shape(text: str, before: str) -> list[str]:
    """The features without a kind."""
    core = text.strip(".,;:!?\"'")
    digits = _digits(core)
    n, share = len(digits), round(4 * len(digits) / max(len(core), 1))
    letters = sum(c.isascii() and c.isalpha() for c in core)
    upper = sum("A" <= c <= "Z" for c in core)
    octets = core.split(".")
    found = [
        f"share{share}", f"digits{min(n, 20)}", f"long{min(len(core) // 8, 6)}", f"tokens{text.count(' ') + 1}",
        f"head{core[:1] if core[:1] in '+(=@' else ''}", f"dots{min(core.count('.'), 4)}",
        f"mixed{bool(letters) and n >= 4}", f"upper{letters > 0 and upper == letters}",
        f"kinds{min(len(PARTS.findall(core)), 12) // 3}",
    ]
    if "@" in core:
        found.append("at" + ("dot" if "." in core.rpartition("@")[2] else ""))
    if 16 <= n <= 19 and not letters:
        found.append(f"luhn{luhn(digits)}")
    if len(octets) == 4 and all(o.isdigit() and len(o) <= 3 and int(o) < 256 for o in octets):
        found.append("octets")
    if core[:1] == "+" and 8 <= n <= 15 and not letters:
        found.append("dialled")
    if "=" in core or "=" in before[-2:]:
        found.append("assigned")
    if re.search(r"key|secret|token|passw|AKIA", core + before[-16:]):
        found.append("spelled")
    return found


class Field:
    """A semi-Markov field: weights of span features; tokens outside spans score nothing."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def scores(self, text: str, tokens: list[tuple[int, int]]) -> dict[tuple[int, int, str], tuple[float, list[str]]]:
        """Score and features of each candidate (first token, token behind the last, kind)."""
        out = {}
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
                begin, end = tokens[i][0], tokens[j - 1][1]
                if not SEED.search(text[tokens[i][0] : tokens[i][1]]) and j > i + 1:
                    lead = text[tokens[i][0] : tokens[i][1]]
                    if not re.search(r"key|secret|token|passw", lead, re.I):
                        break
                if not SEED.search(text, begin, end):
                    continue
                before = text[max(0, begin - 20) : begin]
                own = shape(text[begin:end], before)
                for kind in KINDS:
                    found = [f"{kind}|{f}" for f in own]
                    out[i, j, kind] = sum(self.weights.get(f, 0.0) for f in found), found
        return out

    def best(self, n: int, scores) -> list[tuple[int, int, str]]:
        """Boundaries and kinds with the largest total, by ends of spans."""
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        by_end: dict[int, list] = {}
        for (i, j, kind), (score, _) in scores.items():
            by_end.setdefault(j, []).append((i, kind, score))
        for j in range(1, n + 1):
            top[j], back[j] = top[j - 1], None
            for i, kind, score in by_end.get(j, ()):
                if top[i] + score > top[j] + 1e-12:
                    top[j], back[j] = top[i] + score, (i, j, kind)
        out, j = [], n
        while j:
            out += [back[j]] if back[j] else []
            j = back[j][0] if back[j] else j - 1
        return out[::-1]

    def marginals(self, n: int, scores) -> dict[tuple[int, int, str], float]:
        """Probability of each candidate, by the forward and backward sums."""

        def add(a: float, b: float) -> float:
            return max(a, b) + log(1 + exp(-abs(a - b)))

        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        items = sorted(scores.items())
        by_end: dict[int, list] = {}
        by_begin: dict[int, list] = {}
        for (i, j, _), (score, _) in items:
            by_end.setdefault(j, []).append((i, score))
            by_begin.setdefault(i, []).append((j, score))
        for j in range(1, n + 1):
            forward[j] = forward[j - 1]
            for i, score in by_end.get(j, ()):
                forward[j] = add(forward[j], forward[i] + score)
        for i in range(n - 1, -1, -1):
            backward[i] = backward[i + 1]
            for j, score in by_begin.get(i, ()):
                backward[i] = add(backward[i], backward[j] + score)
        return {c: exp(min(0.0, forward[c[0]] + s + backward[c[1]] - forward[n])) for c, (s, _) in items}

    def learn(self, windows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = EPOCHS, rate: float = 0.3) -> None:
        """Gradient steps on the likelihood of the given spans, window by window, with a small decay."""
        cut = [(text, [m.span() for m in TOKEN.finditer(text)], set(gold)) for text, gold in windows]
        for turn in range(epochs):
            for text, tokens, gold in cut:
                scores = self.scores(text, tokens)
                for candidate, p in self.marginals(len(tokens), scores).items():
                    step = rate / (1 + turn) * ((candidate in gold) - p)
                    if abs(step) > 1e-4:
                        for f in scores[candidate][1]:
                            self.weights[f] = self.weights.get(f, 0.0) * (1 - 1e-4) + step


def taught(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans of tokens that patterns and spelled keys mark in a window."""
    begin, end = tokens[0][0], tokens[-1][1]
    part = text[begin:end]
    marks = base_spans(part) + [("secret", *m.span()) for m in SPELLED.finditer(part)]
    out = []
    for kind, a, b in marks:
        inside = [i for i, (x, y) in enumerate(tokens) if x - begin < b and y - begin > a]
        if inside and len(inside) <= LONGEST and all(not (i < inside[-1] + 1 and inside[0] < j) for i, j, _ in out):
            out.append((inside[0], inside[-1] + 1, kind))
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: int = SAMPLE_TEXTS) -> Field:
    """A field trained on windows of about ``texts`` texts at most, an equal share for each kind, chosen by the hash of the text.

    At most ``SAMPLE_WINDOWS`` windows of each, or one for each kind, come to the driver, of at most
    ``WINDOW`` tokens. Without any, the field has no weights and adds nothing.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                # The first window of each kind, then the first ones.
                first: dict[str, str] = {}
                parts: list[str] = []
                for tokens in windows(t):
                    part = t[tokens[0][0] : tokens[-1][1]]
                    if len(part) < 4000:
                        for kind in {k for k, *_ in base_spans(part)} | ({"secret"} if SPELLED.search(part) else set()):
                            first.setdefault(kind, part)
                        if len(parts) < SAMPLE_WINDOWS:
                            parts.append(part)
                rows += list(dict.fromkeys([*first.values(), *parts]))[: max(SAMPLE_WINDOWS, len(first))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["part"])

    marks = [r"[0-9]{3}|@|=", r"\w@\w", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"([0-9][ -]?){16}", r"\+[0-9][ ().0-9-]{6}", "(?i)" + SPELLED.pattern]
    held = [F.when(F.col("text").rlike(mark), F.lit(i)) for i, mark in enumerate(marks)]
    rows = docs.select(F.col(text).alias("text")).where(F.greatest(*held).isNotNull())
    # Only hashes are sorted, those of each kind by themselves; the texts of the chosen ones are read again.
    kinds = stored(rows.select(F.explode(F.array_compact(F.array(*held))).alias("kind"), F.xxhash64("text").alias("h")).distinct(), "pii-kinds")
    share = -(-texts // len(marks))
    several = [kinds.where(F.col("kind") == i).select("h").orderBy("h").limit(share) for i in range(len(marks))]
    chosen = reduce(DataFrame.union, several).distinct()
    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy("h")
    parts = [r[0] for r in stored(picked.select("text").mapInArrow(task, "part string"), "pii-windows").collect()]
    field = Field()
    cut = [(p, taught(p, [m.span() for m in TOKEN.finditer(p)])) for p in sorted(set(parts))]
    field.learn(cut)
    return field


def overlaps(a: int, b: int, spans: list[Span]) -> bool:
    return any(x < b and a < y for _, x, y in spans)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and those together with the field's."""
    if not SEED.search(text):
        return [], []
    base = base_spans(text)
    added: list[Span] = []
    for tokens in windows(text):
        for i, j, kind in field.best(len(tokens), field.scores(text, tokens)):
            begin, end = tokens[i][0], tokens[j - 1][1]
            while end > begin and text[end - 1] in ".,;:!?":
                end -= 1
            near = [s for s in base if s[1] < end and begin < s[2]]
            # The window before may have cut a span off that is whole in this one.
            cut = [s for s in added[-LONGEST:] if begin <= s[1] and s[2] <= end]
            others = [s for s in added if s not in cut] if cut else added
            if begin < end and not near and not overlaps(begin, end, others):
                added = [*others, (kind, begin, end)] if cut else added
                if not cut:
                    added.append((kind, begin, end))
    # Spelled keys are secrets to the end of their token whatever the field has learned.
    for m in SPELLED.finditer(text):
        begin, end = m.start(), m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        while text[end - 1] in ".,;:!?":
            end -= 1
        if overlaps(begin, end, base):
            continue
        # What the field has found of it goes into one span.
        parts = [s for s in added if overlaps(begin, end, [s])]
        added = [s for s in added if s not in parts] if parts else added
        added.append(("secret", min([begin, *[s[1] for s in parts]]), max([end, *[s[2] for s in parts]])))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPAN_TYPE = "array<struct<kind: string, begin: int, end: int>>"


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: spans as (kind, begin, end) in code points, end exclusive.

    Spans are ordered by kind, then place. A null or empty text has none.
    Repeated rows and null ids stay; an empty table gives no rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for batch in slices(batches):
            both = [all_spans(t, field) for t in batch.column(1).to_pylist()]
            columns = [
                pa.array([[dict(kind=k, begin=a, end=b) for k, a, b in spans[i]] for spans in both], kind) for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(task, f"doc_id long, base {SPAN_TYPE}, spans {SPAN_TYPE}")


def redacted(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``[kind]`` for each span of the text; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)
    names = docs.columns
    rows = docs.select(F.col(text).alias("_text"), *[F.col(f"`{n}`") for n in names])
    at = 1 + names.index(text)

    def clean(value: str | None, field: Field) -> str | None:
        if value is None:
            return None
        out, done = [], 0
        for kind, begin, end in sorted(all_spans(value, field)[1], key=lambda s: (s[1], -s[2])):
            if end > done:
                out += [value[done : max(begin, done)], f"[{kind}]" if begin >= done else ""]
                done = end
        return "".join([*out, value[done:]])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for batch in slices(batches, 0):
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t, field) for t in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns[1:], batch.schema.names[1:])

    return rows.mapInArrow(task, docs.schema)
