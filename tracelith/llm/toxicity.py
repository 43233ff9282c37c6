"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is the sum of a learned vector for the word (for the commonest words of the training texts) and the mean of learned
vectors of its hashed character n-grams and stems (for all words), and the strongest evidence among these n-grams. Windows of ``WINDOW`` words overlap by half and cover the whole
text, the last one ending with it. A window's states are pooled by attention and give a logit; a document's is the
greatest of its windows'. In training the greatest window carries the gradient. Vectors start from the
signed root of each feature's likelihood ratio between the classes of the training texts, less what chance gives (``evidence``). Inference keeps each word's input projections in a table, so a step costs one small product.

The training sample is bounded: at most ``SAMPLE`` labelled documents of each class, those with the least hashes of their
ids, one text for each id; equal texts count once. Only these reach the driver, as whole
texts. Without both classes every score is the share of the class
there is (0.5 without any labels).

Null texts count as empty; texts without words get a score from an empty window. Repeated rows are scored each; a null id
is never held out. Tables without rows give no rows; texts are scored whole, in groups of windows. Other columns, whatever their names,
are never read for a score; ``clean`` keeps them as they are.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_chunks, map_chunks

WINDOW, STRIDE, DIM, HIDDEN, BUCKETS, HINTS, WORDS, GRAMS, STEMS = 64, 32, 12, 8, 1 << 15, 1 << 18, 6000, (3, 4, 5), (6, 7, 8, 9)
SAMPLE, SEED, BATCH, STEPS, CHANCE = 1500, 11, 48, 150, 5.0
#: Words whose projections a worker keeps; windows that are computed at once; words that are held at once (or one text).
TABLE, BLOCK, GROUP = 200_000, 2048, 100_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_windows long"
_WORD = re.compile(r"\w+")
Weights = dict[str, np.ndarray]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many each word has), one word after another: its n-grams of bytes between marks, and its longer stems."""
    coded = [b"<%b>" % x.encode("utf-8", "surrogatepass") for x in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(coded)), sizes)
    left = starts[word] + sizes[word] - np.arange(len(raw))  # bytes of the word from here on
    counts = np.stack([np.maximum(sizes - k + 1, 0) for k in GRAMS] + [(sizes > k).astype(np.int64) for k in STEMS])
    total = counts.sum(0)
    before = np.cumsum(total) - total + np.cumsum(counts, 0) - counts
    out = np.empty(int(total.sum()), np.int64)
    for row, k in enumerate((*GRAMS, *STEMS)):
        at = np.flatnonzero(left >= k) if k in GRAMS else starts[sizes > k]
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + raw[at + j]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out[before[row][word[at]] + (at - starts[word[at]])] = (h >> np.uint64(64 - HINTS.bit_length() + 1)).astype(np.int64)
    return out, total


def starts_of(n: int) -> list[int]:
    """Where a text's windows start: every ``STRIDE`` words, the last one at the end of the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows(ids: np.ndarray, pad: int) -> np.ndarray:
    if len(ids) < WINDOW:
        return np.concatenate([ids, np.full(WINDOW - len(ids), pad, ids.dtype)])[None]
    return ids[np.array(starts_of(len(ids)))[:, None] + np.arange(WINDOW)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(w: Weights, table: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``table``: (words, 2 directions, 3 gates) input projections; ``ids``, ``mask``: (windows, WINDOW)."""
    n, steps = ids.shape
    h, u = np.zeros((2, n, HIDDEN), np.float32), w["u"]
    states = np.empty((steps, n, 2 * HIDDEN), np.float32)
    past = []
    all_there = bool(mask.all())
    for t in range(steps):
        x = np.stack((table[ids[:, t], 0], table[ids[:, steps - 1 - t], 1]))
        a = h @ u
        zr = _sigmoid(x[..., : 2 * HIDDEN] + a[..., : 2 * HIDDEN])
        z, r, an = zr[..., :HIDDEN], zr[..., HIDDEN:], a[..., 2 * HIDDEN :]
        c = np.tanh(x[..., 2 * HIDDEN :] + r * an)
        new = c + z * (h - c)
        if not all_there:
            m = np.stack((mask[:, t], mask[:, steps - 1 - t]))[..., None]
            new = h + m * (new - h)
        if keep:
            past.append((h, z, r, c, an))
        h = new
        states[t, :, :HIDDEN], states[steps - 1 - t, :, HIDDEN:] = h[0], h[1]
    k = np.tanh(states @ w["k"] + w["kb"])
    e = k @ w["q"] + np.where(mask, 0, -30).T.astype(np.float32)
    e = np.exp(e - e.max(0))
    p = e / e.sum(0)
    pooled = np.einsum("tn,tnd->nd", p, states) * mask.any(1)[:, None]
    logit = pooled @ w["o"] + w["ob"]
    return (logit, (past, states, k, p, pooled)) if keep else logit


def backward(w: Weights, ids: np.ndarray, mask: np.ndarray, kept, d: np.ndarray) -> tuple[Weights, np.ndarray]:
    """Gradients of the weights, and of the input projections by (direction, step, window)."""
    past, states, k, p, pooled = kept
    steps, n, _ = states.shape
    g = {"o": pooled.T @ d, "ob": d.sum(keepdims=True)}
    dpool = d[:, None] * w["o"] * mask.any(1)[:, None]
    ds = p[..., None] * dpool
    dp = np.einsum("tnd,nd->tn", states, dpool)
    de = p * (dp - (p * dp).sum(0))
    g["q"] = np.einsum("tn,tna->a", de, k)
    dk = de[..., None] * w["q"] * (1 - k * k)
    g["k"], g["kb"] = np.einsum("tnd,tna->da", states, dk), dk.sum((0, 1))
    ds += dk @ w["k"].T
    dh, du, dx = np.zeros((2, n, HIDDEN), np.float32), np.zeros_like(w["u"]), np.zeros((2, steps, n, 3 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, an = past[t]
        dh = dh + np.stack((ds[t, :, :HIDDEN], ds[steps - 1 - t, :, HIDDEN:]))
        m = np.stack((mask[:, t], mask[:, steps - 1 - t]))[..., None].astype(np.float32)
        dnew = dh * m
        dc = dnew * (1 - z) * (1 - c * c)
        dz = dnew * (h - c) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        da = np.concatenate((dz, dr, dc * r), -1)
        du += h.transpose(0, 2, 1) @ da
        dx[:, t] = np.concatenate((dz, dr, dc), -1)
        dh = dh * (1 - m) + dnew * z + da @ w["u"].transpose(0, 2, 1)
    g["u"] = du
    return g, dx


def word_vectors(w: Weights, own: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The inputs of words, given the rows of their own vectors and, one word after another, their n-grams."""
    at = np.cumsum(sizes) - sizes
    v = w["word"][own] + np.add.reduceat(w["gram"][grams & BUCKETS - 1], at) / sizes[:, None]
    return np.concatenate((v, np.maximum.reduceat(w["hint"][grams], at)[:, None]), 1)


def add_rows(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to rows of a table; rows may repeat."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    table[rows[order][first]] += np.add.reduceat(values[order], first)


class Inputs:
    """Word ids of training texts, with the n-grams of each."""

    def __init__(self, texts: list[str]):
        self.index: dict[str, int] = {}
        self.ids = [np.array([self.index.setdefault(x, len(self.index)) for x in words_of(t)], np.int64) for t in texts]
        words = list(self.index)
        parts = [grams_of(words[a : a + 16_384]) for a in range(0, len(words), 16_384)]
        self.flat = np.concatenate([*(flat.astype(np.int32) for flat, _ in parts), np.zeros(1, np.int32)])
        self.sizes = np.concatenate([*(sizes for _, sizes in parts), np.ones(1, np.int64)])
        self.at = np.cumsum(self.sizes) - self.sizes  # the last one stands for padding


def evidence(rows: Iterable[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """Signed root of each feature's likelihood ratio between the classes (documents that hold it), less what chance gives among many features."""
    n = np.zeros((2, size))
    for ids, label in zip(rows, y, strict=True):
        n[label, np.unique(ids)] += 1
    share = np.bincount(y, minlength=2)[:, None] / len(y)
    g = 2 * (n * np.log(np.maximum(n, 1e-9) / np.maximum(n.sum(0) * share, 1e-9))).sum(0)
    return np.clip(np.sign(n[1] - n.sum(0) * share[1]) * np.maximum(0, np.sqrt(np.maximum(g, 0)) - CHANCE) / 2, -2, 2)


def train(texts: list[str], labels: list[int], prior: float | None = None, seed: int = SEED, steps: int = STEPS) -> tuple[Weights, dict[str, int]] | float:
    """Weights and the words that have a vector of their own; a constant score if a class is missing."""
    known = dict(zip(texts, labels, strict=True))
    texts, y = list(known), np.array(list(known.values()), np.int64)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    rng, data = np.random.default_rng(seed), Inputs(texts)
    size = len(data.index)
    odds = evidence(data.ids, y, size)
    df = np.bincount(np.concatenate([np.unique(i) for i in data.ids]), minlength=size)
    chosen = np.sort(np.argsort(-(np.abs(odds) * 1000 + df), kind="stable")[:WORDS])
    chosen = chosen[df[chosen] >= 3]
    own = np.full(size + 1, len(chosen))
    own[chosen] = np.arange(len(chosen))
    # A document's n-grams one document at a time: together they would be many times the texts.
    gram_rows = (np.concatenate([data.flat[data.at[i] : data.at[i] + data.sizes[i]] for i in np.unique(ids)]) if len(ids) else np.zeros(0, np.int64) for ids in data.ids)
    w: Weights = {k: rng.normal(0, s, shape).astype(np.float32) for k, s, shape in (
        ("word", 0.05, (len(chosen) + 1, DIM)), ("gram", 0.05, (BUCKETS, DIM)), ("x", DIM**-0.5, (DIM + 1, 6 * HIDDEN)), ("u", HIDDEN**-0.5, (2, HIDDEN, 3 * HIDDEN)),
        ("k", (2 * HIDDEN) ** -0.5, (2 * HIDDEN, HIDDEN)), ("q", HIDDEN**-0.5, (HIDDEN,)), ("o", (2 * HIDDEN) ** -0.5, (2 * HIDDEN,)),
    )} | {"xb": np.zeros(6 * HIDDEN, np.float32), "kb": np.zeros(HIDDEN, np.float32), "ob": np.zeros(1, np.float32)}
    w["word"][: len(chosen), 0] += odds[chosen]
    w["hint"] = evidence(gram_rows, y, HINTS).astype(np.float32)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items() if k not in ("word", "gram", "hint")}
    each = [windows(i, size) for i in data.ids]
    pools = [np.flatnonzero(y == c) for c in (0, 1)]
    for step in range(1, steps + 1):
        # half a batch of each class, so that the rare one is learnt
        drawn = np.concatenate([rng.choice(p, BATCH // 2, len(p) < BATCH // 2) for p in pools])
        batch, times = np.unique(drawn, return_counts=True)  # a text that is drawn again isn't computed again
        ids = np.concatenate([each[i] for i in batch])
        first = np.cumsum([0] + [len(each[i]) for i in batch])
        used, inner = np.unique(ids, return_inverse=True)
        inner = inner.reshape(ids.shape)
        gram_of = np.concatenate([np.arange(data.at[i], data.at[i] + data.sizes[i]) for i in used])
        sizes = data.sizes[used]
        flat = data.flat[gram_of]
        v = word_vectors(w, own[used], flat, sizes)
        table = (v @ w["x"] + w["xb"]).reshape(-1, 2, 3 * HIDDEN)
        logit = np.concatenate([forward(w, table, inner[a : a + BLOCK], ids[a : a + BLOCK] < size) for a in range(0, len(ids), BLOCK)])
        top = np.array([a + logit[a:b].argmax() for a, b in zip(first, first[1:])])
        chosen_ids, mask = inner[top], ids[top] < size
        logit, kept = forward(w, table, chosen_ids, mask, True)
        d = ((_sigmoid(logit) - (0.97 * y[batch] + 0.015)) * times / len(drawn)).astype(np.float32)
        g, dx = backward(w, chosen_ids, mask, kept, d)
        dt = np.zeros((len(used), 2, 3 * HIDDEN), np.float32)
        np.add.at(dt[:, 0], chosen_ids.T, dx[0])
        np.add.at(dt[:, 1], chosen_ids.T[::-1], dx[1])
        dt = dt.reshape(len(used), -1)
        g["x"], g["xb"], dv = v.T @ dt, dt.sum(0), dt @ w["x"][:DIM].T
        # Vectors take plain steps, so that a rare word moves little; only words of the chosen windows move.
        moved = np.unique(chosen_ids)
        step_of = -0.5 * dv[moved]
        add_rows(w["word"], own[used[moved]], step_of)
        grams = np.concatenate([data.flat[data.at[i] : data.at[i] + data.sizes[i]] for i in used[moved]])
        add_rows(w["gram"], grams & BUCKETS - 1, np.repeat(step_of / sizes[moved][:, None], sizes[moved], 0))
        rate = 0.03 * min(1, step / 10) * (1 - 0.9 * step / steps)
        for name, grad in g.items():
            m, s = moment[name]
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            w[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    if prior is not None:  # from as many of each class to the classes' own shares
        w["ob"] -= np.float32(np.log((1 - prior) / prior))
    names = list(data.index)
    return w, {names[i]: k for k, i in enumerate(chosen.tolist())}


class Scorer:
    def __init__(self, model: tuple[Weights, dict[str, int]]):
        self.w, self.own = model
        self.index: dict[str, int] = {}
        # a short table of words and projections; row 0 is padding
        self.table = np.zeros((TABLE + 1, 2, 3 * HIDDEN), np.float32)

    def _learn(self, new: list[str]) -> None:
        w, (flat, sizes) = self.w, grams_of(new)
        own = np.array([self.own.get(x, len(w["word"]) - 1) for x in new])
        v = word_vectors(w, own, flat, sizes)
        at = len(self.index) + 1
        self.table[at : at + len(new)] = (v @ w["x"] + w["xb"]).reshape(-1, 2, 3 * HIDDEN)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))

    def _ids(self, words: list[str]) -> np.ndarray | None:
        """Rows of the table, or nothing if it is too full."""
        found = self.index.get
        new = list(dict.fromkeys(x for x in words if x not in self.index))
        if len(self.index) + len(new) > TABLE:
            return None
        if new:
            self._learn(new)
        return np.fromiter(map(found, words), np.int32, len(words))

    def _logits(self, rows: list[np.ndarray]) -> np.ndarray:
        ids = np.concatenate(rows)
        return np.concatenate([forward(self.w, self.table, x, x > 0) for x in (ids[a : a + BLOCK] for a in range(0, len(ids), BLOCK))])

    def scores(self, texts: list[str | None]) -> list[tuple[float, int]]:
        """(score, windows) of each text. Texts are scored in groups of about ``GROUP`` words."""
        out: list[tuple[float, int]] = []
        group: list[list[str]] = []
        size = 0
        for text in texts:
            words = words_of(text)
            if group and size + len(words) > GROUP:
                out += self._group(group)
                group, size = [], 0
            group.append(words)
            size += len(words)
        return out + (self._group(group) if group else [])

    def _group(self, group: list[list[str]]) -> list[tuple[float, int]]:
        # All new words of the group at once, if the table can hold them beside the old ones or alone.
        new = list({x for words in group for x in words if x not in self.index})
        if len(self.index) + len(new) > TABLE:
            self.index.clear()
            new = list({x for words in group for x in words})
        if len(new) <= TABLE:
            for a in range(0, len(new), 4096):
                self._learn(new[a : a + 4096])
        best, counts, held, held_for, size = [-np.inf] * len(group), [0] * len(group), [], [], 0

        def flush():
            nonlocal size
            if held:
                logit, at = self._logits(held), 0
                for k, x in zip(held_for, held, strict=True):
                    best[k] = max(best[k], float(logit[at : at + len(x)].max()))
                    counts[k] += len(x)
                    at += len(x)
            held.clear()
            held_for.clear()
            size = 0

        for k, words in enumerate(group):
            starts, part = starts_of(len(words)), BLOCK * 2
            for a in range(0, len(starts), part):
                own = starts[a : a + part]
                some = words[own[0] : own[-1] + WINDOW]
                if (ids := self._ids(some)) is None:
                    flush()
                    self.index.clear()
                    ids = self._ids(some)
                    if ids is None:
                        raise ValueError("more distinct words in a block of windows than the table holds")
                held.append(windows(ids, 0) if len(own) < 2 else ids[np.array(own)[:, None] - own[0] + np.arange(WINDOW)])
                held_for.append(k)
                size += len(own)
                if size >= BLOCK:
                    flush()
        flush()
        return [(1 / (1 + float(np.exp(-x))), n) for x, n in zip(best, counts, strict=True)]


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[int], float | None]:
    """At most ``sample`` labelled texts of each class that aren't held out, and class 1's share of all such labels. Ids are chosen before texts are read."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi")
    n = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = [marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(some[0].union(some[1])), "doc_id")
    # One text for each id, whatever repeats there are: the greatest hash's.
    rows = rows.groupBy("doc_id", "toxic").agg(F.max_by(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).alias("text")).collect()
    rows = sorted((r.doc_id, r.text, r.toxic) for r in rows)
    return [r[1] for r in rows], [r[2] for r in rows], n[1] / (n[0] + n[1]) if len(n) == 2 else None


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Scores every row of ``docs`` with a network trained on the labelled rows; see SCHEMA."""
    model = train(*training_rows(docs, labels, sample))

    def make():
        scorer = None if isinstance(model, float) else Scorer(model)

        def rows(x):
            out = scorer.scores(x["text"]) if scorer else [(model, len(starts_of(len(words_of(t))))) for t in x["text"]]
            return {"doc_id": x["doc_id"], "held_out": x["held_out"], "score": [s for s, _ in out], "predicted": [int(s >= 0.5) for s, _ in out], "n_windows": [n for _, n in out]}

        return rows

    return map_chunks(docs.select("doc_id", "text", held_out().alias("held_out")), make, SCHEMA)


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, all columns as they are. All rows, with a warning, if the labels leave a class without a training text: a constant score tells no row from another."""
    model = train(*training_rows(docs, labels, sample))
    if isinstance(model, float):
        warnings.warn("no training texts of both classes, so no document is taken for toxic", stacklevel=2)
        return docs

    def make():
        scorer = Scorer(model)
        return lambda texts: [s < 0.5 for s, _ in scorer.scores(texts)]

    return filter_chunks(docs, make, "text")
