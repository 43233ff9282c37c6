"""Secret scans: base patterns, and a character convolutional network in numpy over every candidate with its context.

Base spans come from three patterns and always stay. Further candidates hold a digit and a letter: runs of ``LEAST`` token characters or more,
or what base spans leave of such a run, if it is still one; and shorter values (``SHORT``) that are quoted or stand behind a colon or
an equals sign. The network reads each candidate and the text around it (of a long one, overlapping views of the whole; the greatest score counts), and those at or above its
threshold become spans of kind ``model``. It also scores the base spans (``confidence`` is the greatest of all scores).
The network is trained on labelled findings written by ``findings`` (secrets of several forms, and things that look like
them: identifiers, paths, numbers, placeholders, repeated characters) from a fixed seed. They are split in three: one part is fitted,
one calibrates the scores (Platt), one sets the thresholds: for runs and for short values, the greatest at which recall is still
``RECALL`` among the secrets that no base pattern finds, since these are what the network decides.

Places are code points, ends exclusive. Null texts count as empty and give no spans; rows are kept one for one, also repeated
ones and null ids; tables without rows give none; texts are scanned whole. ``scan`` ignores other columns, whatever their names; ``redact``
keeps them as they are (but for n_chars).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_chunks

#: The base patterns (fixed values of the contract): kind, pattern, the group that counts and its least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
KINDS = (*(k for k, *_ in BASE), "model")
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Quoted or assigned values shorter than that.
SHORT = rf"""(?:[:=]\x20?["']?|["'])([A-Za-z0-9+_.@!#$%&^*~-]{{8,{LEAST - 1}}})(?![A-Za-z0-9+/_=-])"""
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, confidence double"
REDACTED = "[REDACTED]"
#: What the network reads: characters before, the candidate's first and last ones, characters after.
BEFORE, HEAD, TAIL, AFTER = 24, 40, 16, 12
WIDE, DIM, WIDTH, FILTERS, CLASSES = BEFORE + HEAD + TAIL + AFTER, 8, 5, 24, 260
#: Characters between the views of a longer candidate; views that are held at once.
SLIDE, HELD = 16, 8192
_PART = re.compile(rf"[A-Za-z0-9+_-]{{{LEAST},}}")
FINDINGS, EPOCHS, SEED, RECALL = 6000, 6, 5, 0.99


def matchers() -> list:
    # The pattern's own letters in either case (ASCII only) for the first; greedy runs of a least length match as whole runs do.
    assign = re.compile(BASE[0][1], re.IGNORECASE | re.ASCII)
    access = re.compile(r"AKIA[A-Z0-9]{12,}")
    hexes = re.compile(r"[0-9a-f]{32,}")
    return [("assign", assign, 2, 8), ("access", access, 0, 16), ("hex", hexes, 0, 32)]


def base_spans(text: str, rules: list) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), in that order."""
    out = []
    for k, (_, rule, group, least) in enumerate(rules):
        for m in rule.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def candidates(text: str, rule: re.Pattern, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters, or what the base spans (``taken``, by start) leave of them, that are long enough and hold a digit and a letter."""
    out, k, covered = [], 0, 0
    for m in rule.finditer(text):
        at, end = m.span()
        parts = []
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] > max(at, covered):
                parts.append((max(at, covered), taken[k][0]))
            covered = max(covered, taken[k][2])
            k += 1
        parts.append((max(at, covered), end))
        for a, b in parts:
            x = text[a:b]
            if b - a >= LEAST and any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
                out.append((a, b))
    return out


def short_candidates(text: str, rule: re.Pattern, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Short values apart from all of ``taken`` (by start)."""
    out, starts, most = [], [a for a, _ in taken], 0
    ends = [most := max(most, b) for _, b in taken]
    for m in rule.finditer(text):
        a, b = m.span(1)
        k = bisect.bisect_left(starts, b)
        if (not k or ends[k - 1] <= a) and any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1]):
            out.append((a, b))
    return out


def view(text: str, a: int, b: int) -> list[int]:
    """Character classes of a candidate and its context: 0 nothing, then ASCII and other, those inside the candidate apart."""
    code = lambda s, inside: [1 + inside * 129 + min(ord(c), 128) for c in s]
    x = text[a:b]
    head, tail = (x[:HEAD], "") if len(x) <= HEAD else (x[:HEAD], x[HEAD:][-TAIL:])
    left, right = code(text[max(0, a - BEFORE) : a], 0), code(text[b : b + AFTER], 0)
    return [0] * (BEFORE - len(left)) + left + code(head, 1) + [0] * (HEAD - len(head)) + code(tail, 1) + [0] * (TAIL - len(tail)) + right + [0] * (AFTER - len(right))


def views(text: str, a: int, b: int) -> Iterator[list[int]]:
    """All that the network reads of a candidate: its ends, and of one that is longer than a view, overlapping views of the whole and the parts between / and =."""
    yield view(text, a, b)
    if b - a > HEAD + TAIL:
        for i in (*range(a, b - HEAD - TAIL, SLIDE), b - HEAD - TAIL):
            yield view(text, i, i + HEAD + TAIL)
        for m in _PART.finditer(text, a, b):
            if m.end() - m.start() < b - a and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
                yield view(text, *m.span())


def findings(n: int = FINDINGS, seed: int = SEED) -> tuple[list[list[int]], list[int], list[str]]:
    """Labelled findings: views of candidates in invented prose, 1 for secrets, and who finds such a one: base patterns, the network as a run, or as a short value."""
    r = random.Random(seed)
    low, mixed, hexa = string.ascii_lowercase, string.ascii_letters + string.digits, "0123456789abcdef"
    pick = lambda a, k: "".join(r.choice(a) for _ in range(k))
    parts = ["the", "on", "er", "in", "ation", "ly", "ch", "en", "der", "que", "ion", "os", "mente", "ou", "st", "bar", "el", "re", "is"]
    word = lambda: "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    secrets = [
        lambda: f"{r.choice(['password', 'passwd', 'secret', 'token', 'api_key', 'APIKEY', 'Token'])}{r.choice(['=', ': ', ' = ', '=' + chr(34)])}{pick(r.choice([hexa, mixed]), r.randint(12, 44))}",
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: pick(hexa, r.choice([32, 40, 64])),
        lambda: r.choice(["ghp_", "gho_", "sk-", "xoxb-", "glpat-"]) + pick(mixed, r.randint(24, 40)),
        lambda: "eyJ" + pick(mixed + "_-", r.randint(24, 60)),
        lambda: pick(mixed + "+/", r.randint(28, 60)) + "=" * r.randint(0, 2),
    ]
    others = [
        lambda: "_".join(word() for _ in range(r.randint(3, 6))) + f"_{r.randint(1, 99)}",
        lambda: "/".join(word() for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 9999)}",
        lambda: "-".join(word() for _ in range(r.randint(3, 7))) + f"-{r.randint(1, 2030)}",
        lambda: word() + word() + word() + word() + str(r.randint(1, 9)),
        lambda: r.choice("abxz01-=_") * r.randint(20, 40) + r.choice("a1b2"),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}_{word()}",
        lambda: pick(string.digits, r.randint(20, 40)) + "e" + pick(string.digits, 2),
        lambda: f"{r.choice(['password', 'token'])}={r.choice(['changeme', 'placeholder', 'your_password_here', 'example'])}_{word()}1",
        lambda: word().title() + word().title() + word().title() + word().title() + f"V{r.randint(1, 9)}",
    ]
    names, plain = ["pwd", "pass", "auth", "credential", "PRIVATE_KEY", "access-key", "passphrase", "db_pass", "login"], ["version", "id", "width", "color", "file", "time", "ref", "isbn", "date", "chapter", "level", "see"]
    leet = str.maketrans("aeio", "4310")
    chosen = lambda: (word().title() if r.random() < 0.5 else word().translate(leet).title()) + r.choice(["", "!", "@", "#", "_", "&"]) + str(r.randint(1, 9999)) + r.choice(["", "!", "$", "x"])
    short = [lambda: (r.choice(names), chosen()), lambda: (r.choice(names), "".join(r.sample(pick(mixed, r.randint(6, 14)) + pick(string.digits, 2) + pick("!#$%&@_-", r.randint(0, 3)), 8)) + pick(mixed, r.randint(0, 10)))]
    short_others = [
        lambda: (r.choice(plain), f"{word()}{r.choice(['', '_', '-', '.'])}{r.randint(1, 2030)}"), lambda: (r.choice(plain), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}"),
        lambda: (r.choice(plain), f"v{r.randint(1, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}-{r.choice(['beta', 'rc', 'dev'])}{r.randint(1, 9)}"), lambda: (r.choice(plain), f"{word()}@{word()}{r.randint(1, 9)}.com"),
        lambda: (r.choice(names), r.choice(["changeme1", "example1", "your_pass1", "xxxxxxxx1", "password1"])), lambda: (r.choice(plain), f"{r.randint(10, 9999)}{r.choice(['px', 'kg', 'th', 'mm', 'EUR'])}{r.randint(1000, 99999)}"),
    ]
    rows, labels, forms = [], [], []
    for i in range(n):
        if i % 3 == 0:
            while True:
                name, x = r.choice(short if i % 2 else short_others)()
                if 8 <= len(x) < LEAST and any(c.isdigit() for c in x) and any(c.isalpha() for c in x):
                    break
            quote = r.choice(["", '"', "'"])
            before, after = " ".join(word() for _ in range(4)) + r.choice([" ", "\n"]) + name + r.choice(["=", ": ", ":", " = "]) + quote, quote + r.choice([" ", ".", ",", "\n"]) + word()
            rows.append(view(before + x + after, len(before), len(before) + len(x)))
            labels.append(i % 2)
            forms.append("short")
            continue
        which = r.choice(secrets if i % 2 else others)
        x = which()
        forms.append("base" if which in secrets[:3] else "run")
        before, after = " ".join(word() for _ in range(6)) + r.choice([" ", "\n", " (", ": "]), r.choice([" ", ".", ",", "\n", ")"]) + word()
        rows.append(view(before + x + after, len(before), len(before) + len(x)))
        labels.append(i % 2)
    return rows, labels, forms


class Network:
    """Embedding, one convolution, greatest and mean response inside the view, a logistic unit; Adam."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = {"e": r.normal(0, 0.3, (CLASSES, DIM)), "c": r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)), "cb": np.zeros(FILTERS), "o": r.normal(0, 0.1, 2 * FILTERS), "ob": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.scale, self.shift = 1.0, 0.0
        self.thresholds = {"run": 0.5, "short": 0.5}

    def forward(self, x: np.ndarray):
        n, m = len(x), WIDE - WIDTH + 1
        cols = self.w["e"][x][:, np.arange(m)[:, None] + np.arange(WIDTH)].reshape(n, m, -1)
        h = np.maximum(cols @ self.w["c"] + self.w["cb"], 0)
        top = h.argmax(1)
        pooled = np.concatenate((np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)), 1)
        return pooled @ self.w["o"] + self.w["ob"], (cols, h, top, pooled)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logit, (cols, h, top, pooled) = self.forward(x)
        n, m = len(x), h.shape[1]
        d = ((0.5 * np.tanh(0.5 * logit) + 0.5 - y) / n).astype(np.float32)
        g = {"o": pooled.T @ d, "ob": d.sum(keepdims=True)}
        dpool = d[:, None] * self.w["o"]
        dh = np.repeat(dpool[:, None, FILTERS:] / m, m, 1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dpool[:, None, :FILTERS], 1)
        dh *= h > 0
        g["c"], g["cb"] = np.einsum("nmk,nmf->kf", cols, dh, optimize=True), dh.sum((0, 1))
        dcols = (dh @ self.w["c"].T).reshape(n, m, WIDTH, DIM)
        de = np.zeros((n, WIDE, DIM), np.float32)
        for i in range(WIDTH):
            de[:, i : i + m] += dcols[:, :, i]
        g["e"] = np.zeros_like(self.w["e"])
        np.add.at(g["e"], x, de)
        return g

    def scores(self, views: list[list[int]]) -> np.ndarray:
        out = [self.forward(np.array(views[a : a + 1024]))[0] for a in range(0, len(views), 1024)]
        return 1 / (1 + np.exp(-(np.concatenate(out) * self.scale + self.shift))) if out else np.zeros(0)


@functools.cache
def trained(recall: float = RECALL) -> Network:
    rows, labels, forms = findings()
    x, y, form = np.array(rows), np.array(labels), np.array(forms)
    order = np.random.default_rng(SEED).permutation(len(x))
    cut, second = len(x) * 3 // 5, len(x) * 4 // 5
    fit, calibrate, choose, net = order[:cut], order[cut:second], order[second:], Network()
    moments, step = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}, 0
    for epoch in range(EPOCHS):
        for a in range(0, cut, 64):
            step += 1
            part = fit[a : a + 64]
            for k, g in net.gradient(x[part], y[part]).items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                net.w[k] -= (0.01 / (1 + epoch) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    logit, want = net.forward(x[calibrate])[0].astype(float), y[calibrate]
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt: a logistic fit of the labels to the logits
        p = 1 / (1 + np.exp(-(a * logit + b)))
        a, b = a - 0.5 * float(np.mean((p - want) * logit)) / max(1.0, float(np.mean(logit**2))), b - 0.5 * float(np.mean(p - want))
    net.scale, net.shift = a, b
    for kind in net.thresholds:
        found = np.sort(net.scores(x[[i for i in choose if y[i] and form[i] == kind]].tolist()))
        net.thresholds[kind] = float(found[int((1 - recall) * len(found))])
    return net


class Scanner:
    def __init__(self, net: Network):
        self.net, self.rules, self.more, self.short = net, matchers(), re.compile(CANDIDATE), re.compile(SHORT)

    def scan(self, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], float]]:
        """(spans as (start, kind, end) in that order, greatest score) of each text."""
        base, held, of, best = [], [], [], []
        greatest: dict[tuple[int, int, int], float] = {}

        def flush():
            for (k, a, kind, b), p in zip(of, self.net.scores(held).tolist(), strict=True):
                best[k] = max(best[k], p)
                if kind == 3:
                    greatest[k, a, b] = max(greatest.get((k, a, b), 0.0), p)
            held.clear()
            of.clear()

        for k, text in enumerate(texts):
            text = text or ""
            spans = base_spans(text, self.rules)
            base.append(spans)
            best.append(0.0)
            runs = candidates(text, self.more, spans)
            runs += short_candidates(text, self.short, sorted([*((a, b) for a, _, b in spans), *runs]))
            for a, kind, b in [*spans, *((a, 3, b) for a, b in runs)]:
                for x in views(text, a, b) if kind == 3 else [view(text, a, b)]:
                    of.append((k, a, kind, b))
                    held.append(x)
                    if len(held) >= HELD:
                        flush()
        flush()
        for (k, a, b), p in greatest.items():
            if p >= self.net.thresholds["run" if b - a >= LEAST else "short"]:
                base[k].append((a, 3, b))
        return [(sorted(s), p) for s, p in zip(base, best, strict=True)]


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text); see SCHEMA."""
    net = trained()

    def make():
        scanner = Scanner(net)

        def rows(x):
            out = {c.split()[0]: [] for c in SCHEMA.split(", ")} | {"doc_id": x["doc_id"]}
            for spans, best in scanner.scan(x["text"]):
                kinds = [k for _, k, _ in spans]
                for k, c in enumerate(("n_assign", "n_access", "n_hex", "n_model")):
                    out[c].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(written_spans([s for s in spans if s[1] < 3]).encode()).hexdigest())
                out["spans"].append(written_spans(spans))
                out["confidence"].append(best)
            return out

        return rows

    return map_chunks(docs.select("doc_id", "text"), make, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of every text replaced by a mark (one for overlapping ones), n_chars set anew where it is a column. Null texts stay null."""
    net, names = trained(), docs.columns

    def make():
        scanner = Scanner(net)

        def one(text, spans):
            if not spans:
                return text
            out, at = [], 0
            for a, _, b in spans:
                if a >= at:
                    out += [text[at:a], REDACTED]
                at = max(at, b)
            return "".join(out) + text[at:]

        def rows(x):
            texts = [one(t, s) for t, (s, _) in zip(x["text"], scanner.scan(x["text"]), strict=True)]
            return x | {"text": texts}

        return rows

    out = map_chunks(docs, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(names) if "n_chars" in names else out
