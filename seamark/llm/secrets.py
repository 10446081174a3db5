"""Secret scan: rules find the known forms, a small character network judges every other candidate in its context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches, bounded_sample

KINDS = ("assign", "access", "hex", "learned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")    # runs are whole, so a shorter one has no longer one within
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
_PROSE = re.compile(r"[^\x20\x09-\x0D]{8,}")
_WORD = re.compile(r"(?=.*[AEIOUYaeiouy]|.*[^\x00-\x7F]|.{1,3}$)[^\W\d_][^\W\d_A-Z]*")

# What the network sees: characters before, of and after a candidate.
BEFORE, BODY, AFTER = 24, 40, 12
WIDTH, FILTERS, SIGNS = 5, 24, 48
SAMPLE_DOCS = 10000

_SIGN = np.zeros(128, dtype=np.int64)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _SIGN[ord(_c)] = 1 + _k
    _SIGN[ord(_c.upper())] = 27      # capitals and digits by class: their own value says little
_SIGN[48:58] = 28
for _k, _c in enumerate(" \n\"'=:+/_-.,;<>()@"):
    _SIGN[ord(_c)] = 29 + _k
_SIGN[0] = 0

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("base", T.ArrayType(SPAN)), T.StructField("all", T.ArrayType(SPAN)), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The rules' findings, leftmost and without overlap within each kind, by start, then kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Every run of 16 or more key characters that holds letters and digits."""
    for m in _CANDIDATE.finditer(text):
        token = m[0]
        if not token.isalpha() and any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            yield m.span()


def is_plain(token: str) -> bool:
    """Nothing but words, in small letters or capitalised, and short numbers, parted by signs."""
    parts = [p for p in re.split(r"[\W_]+", token) if p]
    return bool(parts) and all(p.isdigit() and len(p) <= 8 or _WORD.fullmatch(p) for p in parts)


def window(text: str, start: int, end: int) -> str:
    """The candidate (its head and tail, if it is long) between its neighbours, at fixed places."""
    body = text[start:end] if end - start <= BODY else text[start:start + BODY - 10] + text[end - 10:end]
    return text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + body.ljust(BODY, "\0") + text[end:end + AFTER].ljust(AFTER, "\0")


def encode(windows: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(windows), BEFORE + BODY + AFTER)
    return np.where(points < 127, _SIGN[np.minimum(points, 127)], SIGNS - 1).astype(np.int8)


@dataclass
class CharNet:
    """One convolution over characters, largest and mean answer of each filter, one logistic unit."""

    kernel: np.ndarray   # (WIDTH, SIGNS, FILTERS)
    shift: np.ndarray
    out: np.ndarray      # (2 * FILTERS,)
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)   # calibration of the logit
    threshold: float = 1.1                    # above 1: nothing is added
    recall: float | None = None               # of held-back findings at the threshold
    false_alarms: float | None = None         # share of held-back others that pass

    def _forward(self, codes: np.ndarray):
        steps = codes.shape[1] - WIDTH + 1
        answer = np.broadcast_to(self.shift.astype(np.float32), (len(codes), steps, FILTERS)).copy()
        for k in range(WIDTH):
            answer += self.kernel[k].astype(np.float32)[codes[:, k:k + steps]]
        np.maximum(answer, 0, out=answer)
        pooled = np.concatenate([answer.max(axis=1), answer.mean(axis=1)], axis=1)
        return answer, pooled, pooled @ self.out + self.bias

    def logits(self, codes: np.ndarray, block: int = 512) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._forward(codes[at:at + block])[2] for at in range(0, len(codes), block))])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        value = self.logits(codes)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * value + self.scale[1], -50, 50)))


def fit(codes: np.ndarray, labels: np.ndarray, recall: float = 0.98, rounds: int = 8, rate: float = 0.005) -> CharNet:
    """Train on two thirds of the labelled findings; calibrate and set the threshold on the rest.

    The threshold is the highest that keeps `recall` of the held-back findings; what part of the
    held-back others passes it is told in `false_alarms`.  Without findings of both
    sorts nothing is learned and nothing is added to the rules.
    """
    rng = np.random.default_rng(5)
    net = CharNet(rng.normal(0, 0.1, (WIDTH, SIGNS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    held = np.arange(len(labels)) % 3 == 2
    if min((labels[~held] == 1).sum(), (labels[~held] == 0).sum(), (labels[held] == 1).sum(), (labels[held] == 0).sum()) < 5:
        return net
    names = ("kernel", "shift", "out", "bias")
    first, second = ({k: np.zeros_like(np.asarray(getattr(net, k), dtype=float)) for k in names} for _ in range(2))
    step = 0
    train = np.flatnonzero(~held)
    weight = np.where(labels == 1, 0.5 / max(1, (labels[train] == 1).sum()), 0.5 / max(1, (labels[train] == 0).sum())) * len(train)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            answer, pooled, logit = net._forward(codes[part])
            slope = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[part]) * weight[part] / len(part)
            grad = {"out": pooled.T @ slope, "bias": slope.sum()}
            steps = answer.shape[1]
            back = np.repeat((slope[:, None] * net.out[None, FILTERS:] / steps)[:, None, :], steps, axis=1)
            top = answer.argmax(axis=1)
            rows, cols = np.indices(top.shape)
            back[rows, top, cols] += slope[:, None] * net.out[None, :FILTERS]
            back *= answer > 0
            grad["shift"] = back.sum(axis=(0, 1))
            flat = back.reshape(-1, FILTERS)
            grad["kernel"] = np.empty_like(net.kernel)
            for k in range(WIDTH):
                hot = np.zeros((len(flat), SIGNS))
                hot[np.arange(len(flat)), codes[part][:, k:k + steps].ravel()] = 1
                grad["kernel"][k] = hot.T @ flat
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * np.square(grad[k])
                move = rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, getattr(net, k) - move)
    net.bias = float(net.bias)
    logit, truth = net.logits(codes[held]), labels[held]
    a, b = 1.0, 0.0
    for _ in range(200):   # calibration: logistic regression on the one logit
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -50, 50)))
        a, b = a - 0.05 * float(np.mean((p - truth) * logit)), b - 0.05 * float(np.mean(p - truth))
    net.scale = (a, b)
    p = net.probability(codes[held])
    keeps = np.quantile(p[truth == 1], 1 - recall, method="lower")
    net.threshold = float(keeps)
    net.recall, net.false_alarms = float((p[truth == 1] >= keeps).mean()), float((p[truth == 0] >= keeps).mean())
    return net


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("window", T.StringType()), T.StructField("secret", T.IntegerType())])))
def _labelled(texts: pa.Array) -> pa.Array:
    """Findings with their label: the rules' ones are secrets, also without their cue; candidates of plain words and the
    longest run of plain words are not.  Other candidates may be secrets that no rule knows, and have no label."""
    out = []
    for text in texts.to_pylist():
        rows = []
        if text:
            base = base_spans(text)
            for k, s, e in base:
                value = s + text[s:e].rfind(_ASSIGN.match(text, s)[2]) if k == "assign" else s
                bare = value if k == "assign" else s + len("AKIA") if k == "access" else s
                rows.append({"window": window(text, value, e), "secret": 1})
                if bare > s:
                    rows.append({"window": window(text[:s] + text[bare:], s, s + e - bare), "secret": 1})
            free = lambda s, e: not any(s < be and bs < e for _, bs, be in base)
            rows += [{"window": window(text, s, e), "secret": 0} for s, e in candidates(text) if free(s, e) and is_plain(text[s:e])]
            plain = max((m.span() for m in _PROSE.finditer(text) if free(*m.span()) and is_plain(m[0])), key=lambda s: s[1] - s[0], default=None)
            if plain:
                rows.append({"window": window(text, *plain), "secret": 0})
        out.append(rows)
    return pa.array(out, pa.list_(pa.struct([("window", pa.string()), ("secret", pa.int32())])))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCS) -> CharNet:
    """Fit on the labelled findings of at most `sample` documents, chosen by a hash of the id."""
    bounded_batches(docs.sparkSession)
    chosen = bounded_sample(docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct(), F.col("id"), sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id", "left_semi")  # at most `sample` ids
    rows = texts.select(F.explode(_labelled("text")).alias("f")).select("f.window", "f.secret").groupBy("window").agg(
        F.max("secret").alias("secret")).toArrow().sort_by([("window", "ascending")])
    # sorted by a hash, so that the part held back is a fair one
    order = np.argsort([hash_of(w) for w in rows["window"].to_pylist()], kind="stable") if len(rows) else np.zeros(0, np.int64)
    codes = encode(rows["window"].to_pylist())[order] if len(rows) else np.zeros((0, BEFORE + BODY + AFTER), np.int8)
    return fit(codes, rows["secret"].to_numpy().astype(float)[order])


def hash_of(text: str) -> int:
    import zlib
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def scan(text: Column, net: CharNet) -> Column:
    """Base spans, all spans (by start, then kind), and the network's score of each candidate that no rule took."""

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            base, windows, places = [], [], []
            for i, text in enumerate(batch.to_pylist()):
                spans = base_spans(text) if text else []
                base.append(spans)
                for s, e in candidates(text) if text else ():
                    if not any(s < be and bs < e for _, bs, be in spans):
                        windows.append(window(text, s, e))
                        places.append((i, s, e))
            every, scores = [list(s) for s in base], [[] for _ in base]
            chance = net.probability(encode(windows)) if windows else ()
            for (i, s, e), p in zip(places, chance):
                scores[i].append(float(p))
                if p >= net.threshold:
                    every[i].append(("learned", s, e))
            for spans in every:
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            as_rows = lambda lists: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in lists], kind)
            yield pa.StructArray.from_arrays([as_rows(base), as_rows(every), pa.array(scores, pa.list_(pa.float64()))], names=FOUND.names)

    return run(text)


def find_secrets(docs: DataFrame, net: CharNet, text_col: str = "text", column: str = "secrets") -> DataFrame:
    """`docs` with a struct column: base, all (spans in code points, end exclusive), scores.

    Each row by itself and over its whole text: ties, repeated rows and other columns change
    nothing; a null or empty text has no spans.
    """
    return docs.withColumn(column, scan(F.col(text_col), net))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every span replaced; spans that overlap are taken together."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(texts.to_pylist(), lists.to_pylist()):
            if text and found:
                parts, at = [], 0
                for s in sorted(found, key=lambda s: s["start"]):
                    if s["start"] >= at:
                        parts += [text[at:s["start"]], mark]
                    at = max(at, s["end"])
                text = "".join(parts) + text[at:]
            out.append(text)
        return pa.array(out, pa.string())

    return F.when(F.size(spans) > 0, run(text, spans)).otherwise(text)
