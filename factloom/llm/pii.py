"""Personal data: fixed rules, and a character tagger trained on labelled spans that adds what they miss.

Labels of the training windows are the rules' own spans in a bounded sample of documents and spans written
in looser forms into its texts.  Every text is decoded whole in overlapping windows.  Their labels are reconciled over the whole
text: where two windows overlap, the seam between them is a place at which both see nothing, else one where they agree, else the
middle; spans are read from the joined labels, so they may be longer than a window.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import lstmcrf
from .shared import frugal, text_column, text_rows

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
#: Training sample: snippets at most.
SNIPPETS = 600
WIDTH, STRIDE = 384, 320
#: Windows that are decoded together, and the width of those that the tagger is trained on.
GROUP, TRAIN_WIDTH = 1024, 96
#: Characters of texts that are decoded together, at least one text.
CHUNK = 1 << 20
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Matches can only begin where a run of digits does, so looking back keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
#: Symbol of a line end, which also pads windows.
LINE_END = 95


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed rules, by kind and start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _plausible(kind: int, s: str) -> bool:
    """What an added span has to have at least."""
    d = _digits(s)
    if kind == 0:
        return s.count("@") == 1 and re.fullmatch(r"\S+ ?@ ?[A-Za-z0-9-]+(?: ?\. ?[A-Za-z0-9-]+)+", s) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and not re.search(r"[A-Za-z]", s)


def _inside_a_word(t: str, x: int, z: int) -> bool:
    """Does an end of the span cut a run of letters or digits?"""
    return x > 0 and (t[x - 1] + t[x]).isalnum() or z < len(t) and (t[z - 1] + t[z]).isalnum()


def _label_spans(y: np.ndarray):
    """(kind, start, end) of runs of one label: 0 is outside, k + 1 is kind k."""
    edge = np.flatnonzero(np.diff(y, prepend=0, append=0))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if y[a]:
            yield int(y[a]) - 1, a, b


def _seam(a: np.ndarray, b: np.ndarray) -> int:
    """Where to go from the labels ``a`` of the overlap to ``b``: a place where both are outside, else where they agree, nearest the middle."""
    places = np.abs(np.arange(len(a)) - len(a) // 2)
    for ok in ((a == 0) & (b == 0), a == b):
        if ok.any():
            return int(np.where(ok, places, len(a)).argmin())
    return len(a) // 2


def labels(texts: list[str], weights: dict) -> list[np.ndarray]:
    """Labels of every character of each text, stitched from the windows that cover it."""
    own = [lstmcrf.symbols(t) for t in texts]
    jobs = [(k, s) for k, m in enumerate(own) for s in range(0, max(1, len(m) - (WIDTH - STRIDE)), STRIDE) if len(m)]
    width = [-(-min(WIDTH, len(own[k]) - s) // 32) * 32 for k, s in jobs]
    order = np.argsort(np.array(width, np.int64), kind="stable")
    out = [np.zeros(len(m), np.int8) for m in own]
    cut: dict[tuple, np.ndarray] = {}
    held: list[tuple[list, np.ndarray]] = []

    def search():
        e = np.full((WIDTH, 1 + len(KINDS), sum(len(x) for x, _ in held)), -1e9, np.float32)
        e[:, 0] = 0  # beyond a shorter window there is nothing
        n = 0
        for x, own_e in held:
            e[: len(own_e), :, n : n + len(x)] = own_e
            n += len(x)
        for job, y in zip([j for x, _ in held for j in x], lstmcrf.best(weights, e).T, strict=True):
            if y.any():
                cut[job] = y
        held.clear()

    for part in np.split(order, np.flatnonzero(np.diff(np.array(width, np.int64)[order])) + 1):
        for at in range(0, len(part), GROUP):
            some = part[at : at + GROUP].tolist()
            m = np.full((len(some), width[some[0]]), LINE_END, np.int64)
            for r, j in enumerate(some):
                k, s = jobs[j]
                m[r, : min(WIDTH, len(own[k]) - s)] = own[k][s : s + WIDTH]
            found, e = lstmcrf.open_rows(weights, m)
            if len(found):
                held.append(([jobs[some[r]] for r in found.tolist()], e))
            if sum(len(x) for x, _ in held) >= GROUP:
                search()
    if held:
        search()
    nothing = np.zeros(WIDTH, np.int8)
    for k, s in sorted({x for k, s in cut for x in ((k, s), (k, s + STRIDE)) if x[1] == s or s + STRIDE < len(own[k]) - (WIDTH - STRIDE)}):
        y, n = cut.get((k, s), nothing), min(WIDTH, len(own[k]) - s)
        seam = _seam(cut.get((k, s - STRIDE), nothing)[STRIDE:], y[: WIDTH - STRIDE]) if s else 0
        out[k][s + seam : s + n] = y[seam:n]
    return out


def add_spans(texts: list[str], base: list[list], weights: dict) -> list[list]:
    """Spans that the tagger adds to each text; none overlaps another or a rule's span."""
    out = []
    for t, own, y in zip(texts, base, labels(texts, weights), strict=True):
        taken, kept = [(x, z) for _, x, z in own], []
        for kind, x, z in sorted(_label_spans(y) if y.any() else (), key=lambda v: (v[1] - v[2], v[1], v[0])):
            while x < z and t[x] in " \n.,;:":
                x += 1
            while z > x and t[z - 1] in " \n.,;:":
                z -= 1
            if x < z and not _inside_a_word(t, x, z) and _plausible(kind, t[x:z]) and all(z <= b or x >= e for b, e in taken):
                taken.append((x, z))
                kept.append((kind, x, z))
        out.append(kept)
    return out


def _loose(rng) -> tuple[int, str]:
    """A span in a form that people write and the rules may miss."""
    num = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    kind = int(rng.integers(4))
    if kind == 0:
        at = (" @ ", "@ ", " @", "@")[rng.integers(4)]
        return 0, f"{word(rng.integers(3, 9))}.{num(2)}{at}mail{num(1)}.{word(6)}.{('com', 'org', 'net')[rng.integers(3)]}"
    if kind == 1:
        return 1, (" . ", ". ", ".", "[.]")[rng.integers(4)].join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return 2, (".", "_", " ", "-", "", "  ")[rng.integers(6)].join(d[i : i + 4] for i in range(0, 16, 4))
    return 3, (f"({num(3)}) 555-{num(4)} {num(2)}", f"+1 ({num(3)}) 555-{num(4)}", f"001 {num(3)} 555 {num(4)}", f"+1/{num(3)}/555/{num(4)}")[rng.integers(4)]


def training_windows(snippets: list[str], seed: int = 7):
    """Label rows over windows: the rules' spans where they stand, and looser ones written into the texts."""
    rng = np.random.default_rng(seed)
    texts, marks = [], []
    for t in [*snippets, *[s for s in snippets if not _ANCHOR.search(s)], *["the and of to in is"] * 200]:
        t = t[:400]
        spans = base_spans(t)
        if rng.random() < 0.7:
            kind, s = _loose(rng)
            cut = [i for i, c in enumerate(t) if c == " " and all(i < a or i >= b for _, a, b in spans)]
            if cut:
                i = cut[rng.integers(len(cut))] + 1
                t = t[:i] + s + " " + t[i:]
                spans = [(k, a, b) if b <= i else (k, a + len(s) + 1, b + len(s) + 1) for k, a, b in spans] + [(kind, i, i + len(s))]
        y = np.zeros(len(t), np.int64)
        for k, a, b in spans:
            y[a:b] = k + 1
        texts.append(t)
        marks.append(y)
    m, ys = [], []
    for t, y in zip(texts, marks, strict=True):
        own = lstmcrf.symbols(t)
        anchors = [x.start() for x in _ANCHOR.finditer(t)]
        # a window around each span or digit at a place that varies, and one from anywhere
        for a in [*anchors[:: max(1, len(anchors) // 6)], int(rng.integers(max(1, len(t))))]:
            s = max(0, min(a - int(rng.integers(TRAIN_WIDTH)), len(t) - TRAIN_WIDTH))
            n = len(own[s : s + TRAIN_WIDTH])
            m.append(np.pad(own[s : s + n], (0, TRAIN_WIDTH - n), constant_values=LINE_END))
            ys.append(np.pad(y[s : s + n], (0, TRAIN_WIDTH - n)))
    return np.stack(m), np.stack(ys)


def fit(docs: DataFrame, text="text") -> dict:
    """Tagger weights from a bounded sample of snippets: half around a digit or at-sign, half from anywhere.

    Texts are thinned by their hash before anything is shuffled; copies of a text are one.
    """
    src = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    n = docs.agg(F.count(F.col(text)).alias("n")).first()["n"]
    thin = src.where(F.pmod("h", F.lit(1 << 20)) * F.lit(n) < F.lit(40 * SNIPPETS << 20))
    near = thin.where(F.col("t").rlike("[0-9@]")).select(
        "h", F.expr("substr(t, greatest(regexp_instr(t, '[0-9@]') - 150, 1), 400)").alias("s")
    )
    far = thin.select("h", F.substring("t", 1, 400).alias("s"))
    rows = [r.s for x in (near, far) for r in x.groupBy("h").agg(F.first("s").alias("s")).orderBy("h").limit(SNIPPETS // 2).collect()]
    return lstmcrf.train(*training_windows(rows), 1 + len(KINDS))


def _find(weights, place):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in text_column(batch, place).to_pylist()]
            at = 0
            while at < len(texts):  # a megabyte or so at a time, at least one text
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= CHUNK:
                    size += len(texts[to])
                    to += 1
                some = texts[at:to]
                base = [base_spans(t) for t in some]
                spans = []
                for own, new in zip(base, add_spans(some, base, weights.value), strict=True):
                    every = sorted([(*s, True) for s in own] + [(*s, False) for s in new])
                    spans.append([{"kind": KINDS[s[0]], "start": s[1], "end": s[2], "base": s[3]} for s in every])
                part = batch.slice(at, to - at)
                yield pa.record_batch([*part.columns, pa.array(spans, SPAN_TYPE)], [*batch.schema.names, "spans"])
                at = to

    return run


def find_pii(docs: DataFrame, weights: dict, doc_id="doc_id", text="text", whole_row=False) -> DataFrame:
    """``doc_id``, ``text``, ``spans`` (kind, start, end in code points, base) for every row, ordered by kind and start.

    With ``whole_row`` the input row comes as struct ``row`` instead of ``text``.  Null and empty texts have no spans.  Repeated rows are
    read one by one; an empty table gives no rows; other columns are ignored.  Every text is searched whole.
    """
    rows, place = text_rows(docs, doc_id, text, whole_row)
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL(f"spans {SPANS}")])
    weights = docs.sparkSession.sparkContext.broadcast(weights)
    return rows.mapInArrow(frugal(_find(weights, place)), schema).withColumnsRenamed({"doc_id": doc_id, "text": text})


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; where spans overlap, the first stands for all."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    walked = F.aggregate(
        by_place,
        start,
        lambda acc, s: F.when(s["b"] <= acc["at"], acc).otherwise(
            F.struct(
                s["b"].alias("at"),
                F.when(s["a"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["a"] - acc["at"]), F.lit("["), s["k"], F.lit("]")))
                .alias("out"),
            )
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(walked["out"], F.substr(text, walked["at"] + 1, F.char_length(text)))
    )
