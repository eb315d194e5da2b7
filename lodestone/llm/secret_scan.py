"""Secret scans: base patterns, and a character convolutional network over every other candidate.

A candidate is a run of characters that secrets consist of, or a part of one that base findings leave open: of 12 or more
characters with a digit or with capitals after small letters, or of 6 or more after a key word or a separator.  Long ones
are scored in overlapping windows over their whole length.  The network (one convolution over
the characters of the candidate and its surroundings, maxima over both parts, one hidden layer) is written in numpy and
trained on labelled findings: all distinct candidates of the corpus, labelled by whether a base finding
covers them, and a seeded set of made-up ones.  If they are many, shards of them train side by side where they lie, and the
networks are averaged round by round.  Base findings miss secrets, so a first network, of base findings and made-up
ones alone, sets aside the candidates of the corpus that look like secrets without being covered.  A third of the findings, none of whose values the network was trained on,
calibrates its scores (Platt) and sets the threshold: the highest that still finds the wanted share of the secrets.
"""

from __future__ import annotations

import copy
import hashlib
import math
import random
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, text_of, workspace

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

RUN = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
ANY = re.compile(r"[A-Za-z0-9+/_=.-]{6,}")
TELLS = re.compile(r"[0-9]|[a-z][A-Z]")  # in a run of this length
SHORT = re.compile(
    r"""(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|auth|bearer|credentials?|login|pin)["']?(?:\s{1,3}(?:is|was))?|[:=>])[\s"'`(]{1,4}(?=[A-Za-z0-9+/_=.-]{6})""",
    re.IGNORECASE | re.ASCII,
)
BEFORE, INSIDE, AFTER = 28, 56, 12
WIDTH = BEFORE + INSIDE + AFTER
STEP = INSIDE // 2  # so a secret of up to 40 characters has 34 or more in one window
CLASSES = 130  # ASCII, any other character, nothing

Span = tuple[int, int, int]


def base_findings(text: str) -> list[Span]:
    """(start, kind, end) of the base patterns, in order."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ("pass", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def runs(text: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and end of each run between begin and end that is a candidate, if no base finding covers it; in order."""
    end = len(text) if end is None else end
    keyed = {m.end() for m in SHORT.finditer(text, max(0, begin - BEFORE), end)}
    for m in (ANY if keyed else RUN).finditer(text, begin, end):
        if m.start() in keyed or m.end() - m.start() >= 12 and TELLS.search(text, *m.span()):
            yield m.span()


def parts(text: str, found: list[Span]) -> Iterator[tuple[int, int, int]]:
    """Start, end and label of the parts of each run: 1 for what a base finding covers, 0 for candidates: the stretches between
    them that would be runs on their own."""
    merged: list[list[int]] = []
    for start, _, end in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    ends = [e for _, e in merged]
    for start, end in runs(text):
        at = start
        k = bisect_right(ends, start)
        while k < len(merged) and merged[k][0] < end:
            s, e = max(start, merged[k][0]), min(end, merged[k][1])
            yield from ((a, b, 0) for a, b in runs(text, at, s))
            yield s, e, 1
            at, k = e, k + 1
        if at == start:
            yield start, end, 0
        else:
            yield from ((a, b, 0) for a, b in runs(text, at, end))


def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """The span itself, or spans of INSIDE characters, STEP apart and the last one at the end, that cover a longer one."""
    if end - start <= INSIDE:
        yield start, end
        return
    for s in range(start, end - INSIDE, STEP):
        yield s, s + INSIDE
    yield end - INSIDE, end


def window(text: str, start: int, end: int) -> str:
    """WIDTH characters: what stands before, up to INSIDE characters, what stands after."""
    before, inside, after = text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]
    return before.rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + after.ljust(AFTER, "\0")


def encode(windows: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), "<u4").reshape(len(windows), WIDTH)
    return np.where(codes == 0, 129, np.minimum(codes, 128)).astype(np.int64)


class CharCNN:
    """Convolution of five characters, maxima over surroundings and candidate, a hidden layer, a calibrated logistic output."""

    def __init__(self, filters: int = 24, hidden: int = 16, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"conv": rng.normal(0, 0.1, (5, CLASSES, filters)), "b0": np.zeros(filters), "w1": rng.normal(0, 0.2, (2 * filters, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 0.3, hidden), "b2": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        p, t = self.p, x.shape[1] - 4
        z = p["b0"] + sum(p["conv"][k][x[:, k : k + t]] for k in range(5))
        inside = slice(BEFORE - 2, BEFORE - 2 + INSIDE)
        around = np.r_[0 : BEFORE - 2, BEFORE - 2 + INSIDE : t]
        at_in = z[:, inside].argmax(1) + BEFORE - 2
        at_out = around[z[:, around].argmax(1)]
        at = np.stack([at_in, at_out], 1)
        pooled = np.take_along_axis(z, at, 1).reshape(len(x), -1)
        h0 = np.maximum(pooled, 0)
        h1 = np.maximum(h0 @ p["w1"] + p["b1"], 0)
        return h1 @ p["w2"] + p["b2"][0], {"at": at, "h0": h0, "h1": h1}

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        z, c = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(x)
        dh1 = np.outer(dz, p["w2"]) * (c["h1"] > 0)
        dh0 = (dh1 @ p["w1"].T) * (c["h0"] > 0)
        g = {"w2": c["h1"].T @ dz, "b2": np.array([dz.sum()]), "w1": c["h0"].T @ dh1, "b1": dh1.sum(0), "conv": np.zeros_like(p["conv"])}
        filters = p["conv"].shape[2]
        part = dh0.reshape(len(x), 2, filters)
        g["b0"] = part.sum((0, 1))
        rows, which = np.arange(len(x))[:, None, None], np.broadcast_to(np.arange(filters), part.shape)
        for k in range(5):
            np.add.at(g["conv"][k], (x[rows, c["at"] + k], which), part)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 42) -> None:
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for k, g in self.gradient(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    g = g + 1e-4 * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        self.calibrate_scores(self.logits(x), y, np.ones(len(y)), recall)

    def calibrate_scores(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt scaling of scores that n findings each have, by Newton steps, then the highest threshold with at least this recall; one
        half without secrets."""
        total, secrets = n.sum(), (n * y).sum()
        spread = float(np.sqrt((n * (z - (n * z).sum() / total) ** 2).sum() / total)) if total else 1.0
        spread = spread or 1.0
        target = np.where(y > 0, (secrets + 1) / (secrets + 2), 1 / (total - secrets + 2))
        design = np.stack([z / spread, np.ones_like(z)], 1)
        loss = lambda t: float((n * (np.logaddexp(0, design @ t) - target * (design @ t))).sum() + 5e-4 * (t @ t))
        theta = np.array([1.0, 0.0])
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
            hessian = (design * (n * q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, design.T @ (n * (q - target)) + 1e-3 * theta)
            while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:  # else it can run away where the classes are apart
                step = step / 2
            theta = theta - step
        theta = theta / (spread, 1)
        self.scale, self.shift = float(max(theta[0], 1e-3)), float(theta[1])
        order = np.flatnonzero(y > 0)[np.argsort(z[y > 0], kind="stable")]
        at = np.searchsorted(np.cumsum(n[order]), math.floor((1 - recall) * secrets), side="right")
        self.threshold = float(self._odds(z[order])[at]) if len(order) else 0.5

    def logits(self, x: np.ndarray, chunk: int = 2048) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + chunk])[0] for i in range(0, len(x), chunk)]) if len(x) else np.zeros(0)

    def _odds(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60)))

    def averaged(self, weights: list[tuple[int, bytes]]) -> CharCNN:
        """A copy whose weights are the mean of those that flat() gave, each counted as often as its number says."""
        out, at = copy.deepcopy(self), 0
        total = sum(n for n, _ in weights)
        mean = sum(n / total * np.frombuffer(w) for n, w in weights) if total else np.frombuffer(self.flat())
        for k, v in self.p.items():
            out.p[k] = mean[at : at + v.size].reshape(v.shape).copy()
            at += v.size
        return out

    def flat(self) -> bytes:
        return np.concatenate([v.ravel() for v in self.p.values()]).tobytes()

    def probability(self, x: np.ndarray, chunk: int = 2048) -> np.ndarray:
        return self._odds(self.logits(x, chunk))


WORDS = """about above account action address after again against always another answer archive article because before between
branch building business change children class client common company content control country course default different
document during english example family feature first following function general government group health history however
image important index inside interest language library little local machine market member message method minute module
moment month mother music nature network never nothing number object office order other package parent people person
picture place point possible power president private problem process program project public question really record region
release result right school screen script search season second section server service should simple small social something
source spring standard state station still street structure student style summer support system table teacher template
theme thing thought through together travel under update upload until user value version village water website weekend
where which while window without woman world would writing yellow young aber auch diese durch einen gegen haben jahre
können mehr nicht noch oder schon sein sich über unter wieder zwischen alors aussi avec cette comme dans depuis deux
encore entre faire leur même notre plus pour sans sont tout très ahora años bien cada como cuando desde donde ella entre
este gran hasta hacer mismo mucho mundo nuestro otros parte pero porque siempre sobre también tiempo todo vida""".split()


def made_up(n: int, seed: int) -> list[tuple[str, int]]:
    """Seeded findings: secrets of usual forms (1), and numbers, addresses, dates, names and paths (0), in varied surroundings."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = [a + b for a in "bdklmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er")]
    word = lambda: rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    secret = [
        lambda: pick("0123456789abcdef", rng.choice((32, 40, 64))),
        lambda: pick(lower + upper + digit, rng.randint(24, 44)) + pick(digit, 1),
        lambda: pick(lower + upper + digit + "+/", rng.randint(30, 60)) + "1==",
        lambda: "AKIA" + pick(upper + digit, 16),
        lambda: f"{pick(lower, 2)}_{pick(lower, 4)}_{pick(lower + upper + digit, 30)}7",
    ]
    letters = [
        lambda: pick(lower + upper, rng.randint(16, 48)),
        lambda: pick(lower, 2) + pick(lower + upper, rng.randint(20, 40)),
    ]
    keyed = [  # short ones, which a key word must stand before
        lambda: pick(lower + upper + digit, rng.randint(6, 11)),
        lambda: pick(lower, rng.randint(4, 7)) + pick(digit, rng.randint(2, 4)),
        lambda: pick(lower + upper, rng.randint(8, 14)),
    ]
    prose = [
        lambda: word() + word() + word(),
        lambda: (word() + word()).title() + rng.choice(("", ".")),
        lambda: "".join(word().title() for _ in range(rng.randint(2, 5))),
        lambda: word() + "".join(word().title() for _ in range(rng.randint(2, 4))),
        lambda: f"{word()}-{word()}-{word()}",
        lambda: pick(digit, rng.randint(6, 9)),
    ]
    names = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "access key", "Key", "auth", "Bearer", "credentials", "login", "pin")
    clean = [
        lambda: pick(digit, rng.randint(12, 19)),
        lambda: ".".join(str(rng.randint(100, 255)) for _ in range(4)),
        lambda: f"{word()}.{word()}{rng.randint(1, 99)}.example.com",
        lambda: f"20{pick(digit, 2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}.{word()}",
        lambda: f"{word()}-{word()}-{word()}{rng.randint(1, 2100)}",
        lambda: f"{word()}/{word()}/{word()}_{rng.randint(1, 99)}.txt",
        lambda: f"+{pick(digit, 2)}-{pick(digit, 3)}-{pick(digit, 7)}",
    ]

    def filler(most: int) -> str:
        """A long path, dotted name or the like."""
        mark, out = rng.choice("///..-_="), ""
        while len(out) < most:
            out += rng.choice((word(), word(), word().title(), word() + pick(digit, rng.randint(1, 4)))) + (mark if rng.random() < 0.8 else rng.choice("/.-_="))
        return out

    out = []
    for i in range(n):
        label = i % 2
        value = rng.choice(secret if label else clean)()
        lead = " ".join(word() for _ in range(6)) + rng.choice((" ", ": ", " = ", " '", '="', "\n"))
        if i % 5 == 3 or i % 5 == 4:  # without digits, or short
            value = rng.choice(letters if label and i % 3 else keyed if label else prose)()
            if label and not i % 3:
                lead = lead.split(" ", 1)[0] + f" {word()} {rng.choice(names)}" + rng.choice((" ", " is ", " was ", ": ", " = ", ": '", '="', ' "'))
        start, end = len(lead), len(lead) + len(value)
        if i % 6 > 3 and i % 5 < 3:  # inside a long run
            ahead, behind = filler(rng.randint(1, 120)), filler(rng.randint(1, 120))
            run = len(lead), len(lead + ahead + value + behind) + 1
            start, end = start + len(ahead), end + len(ahead)
            value = f"{ahead}{value}{rng.choice('/.-_=')}{behind}"
            overlap = {p: min(p[1], end) - max(p[0], start) for p in pieces(*run)}
            start, end = max(overlap, key=overlap.get)
        text = lead + value + rng.choice(("", '"', "'", ".", " ")) + " " + word() + " " + word()
        out += [(window(text, s, e), label) for s, e in list(pieces(start, end))[:1]]
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the parts of a task's runs, whether a base finding covers them, and a hash of the part."""
    for batch in batches:
        windows, labels, values = [], [], []
        for text in batch.column(0).to_pylist():
            for start, end, label in parts(text, base_findings(text)):
                for piece in pieces(start, end):
                    windows.append(window(text, *piece))
                    labels.append(label)
                    values.append(zlib.crc32(text[start:end].encode()))
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(labels, pa.int32()), pa.array(values, pa.int64())], names=["window", "label", "value"])


#: Most shards that train side by side; the driver gets a network (130 kB) from each and sends back their mean.
SHARDS = 64
#: How often the shards' networks are averaged, and how often each passes over its shard in between.
ROUNDS, EPOCHS = 4, 3
#: Scores are counted by steps of this part of one for calibration.
STEPS = 1000


def train_model(docs: DataFrame, *, text_col: str = "text", max_findings: int = 3000, synthetic: int = 3000, recall: float = 0.97, seed: int = 42) -> CharCNN:
    """Fits the network to all distinct labelled candidates of the corpus and the made-up ones, and calibrates it on a third of both.

    Up to max_findings candidates are fitted at the driver; more of them in shards of about that many, where they lie.
    """
    found = docs.select(text_of(text_col)).mapInArrow(_labelled, "window string, label int, value long").groupBy("window").agg(F.max("label").alias("label"), F.min("value").alias("value"))
    found = materialize(found, workspace(docs.sparkSession, "secrets") + "/windows")
    own = made_up(synthetic, seed)
    random.Random(seed).shuffle(own)
    n = found.count()
    return _fit_all(found, own, recall, seed) if n <= max_findings else _fit_in_shards(found, min(SHARDS, -(-n // max_findings)), own, recall, seed)


def _sides(rows: list[tuple[str, int, int]]) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Pairs of window and label to train on and to calibrate with; all windows of a value go to one side."""
    third, rest = [], []
    for window_, label, value in rows:
        (rest if value % 3 else third).append((window_, label))
    rest += [("\0" * BEFORE + w[BEFORE:], y) for w, y in rest if y and any(runs(w[BEFORE : BEFORE + INSIDE]))]  # the value alone must do as well, if it is a candidate
    return rest, third


def _fit_all(found: DataFrame, own: list[tuple[str, int]], recall: float, seed: int) -> CharCNN:
    """The network of candidates that are few."""
    few = [tuple(r) for r in found.orderBy(F.xxhash64("window", F.lit(seed)), "window").select("window", "label", "value").collect()]
    rest, third = _sides(few)
    at = len(own) // 3
    if any(not y for _, y in rest + third):
        first = CharCNN(seed=seed)
        first.train(*_arrays([p for p in rest if p[1]] + own[at:]), seed=seed)
        third, rest = (_without_doubtful(first, pairs) for pairs in (third, rest))
    third += own[:at]
    rest += own[at:]
    random.Random(seed).shuffle(rest)
    model = CharCNN(seed=seed)
    model.train(*_arrays(rest), seed=seed)
    model.calibrate(*_arrays(third), recall)
    return model


def _fit_in_shards(found: DataFrame, shards: int, own: list[tuple[str, int]], recall: float, seed: int) -> CharCNN:
    """The network of any number of candidates: from one of made-up ones, each shard goes on with its candidates and the made-up ones;
    their mean begins the next round, at a lower rate.  The scores of the third are counted by small steps, rounded down."""
    at = len(own) // 3
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("window", F.lit(seed)), F.lit(shards))).repartition(shards, "shard")  # else AQE puts small shards into one task
    start = CharCNN(seed=seed)
    start.train(*_arrays(own[at:]), seed=seed)

    def trained(first: CharCNN | None) -> CharCNN:
        model = start
        for turn in range(ROUNDS):
            fitted = dealt.groupBy("shard").applyInArrow(_round(model, first, own[at:], 0.004 / (turn + 1), seed + turn), "n long, weights binary")
            model = model.averaged(sorted((r["n"], bytes(r["weights"])) for r in fitted.collect()))  # SHARDS rows at most
        return model

    first = trained(None)
    model = trained(first)
    counts = found.where("value % 3 = 0").mapInArrow(_scores(model, first), "step long, label int").groupBy("step", "label").count().collect()  # a row per step
    z, y, n = (np.array([r[k] for r in counts], float) for k in ("step", "label", "count"))
    x, labels = _arrays(own[:at])
    model.calibrate_scores(np.r_[z / STEPS, model.logits(x)], np.r_[y, labels], np.r_[n, np.ones(len(x))], recall)
    return model


def _round(model: CharCNN, first: CharCNN | None, own: list[tuple[str, int]], rate: float, seed: int):
    """What a shard (window, label, value) makes of the network, and from how many pairs; without a first network, of secrets alone."""

    def fit(shard: pa.Table) -> pa.Table:
        pairs, _ = _sides(sorted(zip(*(shard[c].to_pylist() for c in ("window", "label", "value")))))
        pairs = [p for p in pairs if p[1]] if first is None else _without_doubtful(first, pairs)
        pairs += own
        random.Random(seed).shuffle(pairs)
        mine = copy.deepcopy(model)
        mine.train(*_arrays(pairs), epochs=EPOCHS, rate=rate, seed=seed)
        return pa.table({"n": pa.array([len(pairs)], pa.int64()), "weights": pa.array([mine.flat()], pa.binary())})

    return fit


def _scores(model: CharCNN, first: CharCNN):
    """Windows (window, label) without the doubtful ones as steps of their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = _without_doubtful(first, list(zip(batch.column("window").to_pylist(), batch.column("label").to_pylist())))
            z = model.logits(encode([w for w, _ in pairs]))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(z * STEPS).astype(np.int64)), pa.array([y for _, y in pairs], pa.int32())], names=["step", "label"])

    return run


def _without_doubtful(model: CharCNN, pairs: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Pairs without the candidates that no base finding covers but the model takes for secrets.

    The base patterns miss secrets, so a candidate outside them is clean only if it doesn't look like one either; else the
    network would learn from the corpus's other secrets that such are none.
    """
    odds = model.probability(encode([w for w, _ in pairs]))
    return [p for p, q in zip(pairs, odds) if p[1] or q < 0.5]


def _arrays(pairs: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    return encode([w for w, _ in pairs]), np.array([y for _, y in pairs], float)


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _scan(model: CharCNN):
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [base_findings(text) for text in texts]
            open_pieces = ((i, s, e) for i, text in enumerate(texts) for start, end, label in parts(text, found[i]) if not label for s, e in pieces(start, end))
            extra: dict[int, list[Span]] = {}
            for some in batched(open_pieces, 2048):
                for (i, s, e), q in zip(some, model.probability(encode([window(texts[i], s, e) for i, s, e in some]))):
                    if q >= model.threshold:
                        own = extra.setdefault(i, [])
                        if own and s < own[-1][2]:  # pieces of one candidate
                            s = own.pop()[0]
                        own.append((s, 3, e))
            counts = [[sum(k == kind for _, k, _ in base) for base in found] for kind in range(3)]
            digests = [hashlib.sha256(render(base).encode()).hexdigest() for base in found]
            spans = [render(base + extra.get(i, [])) for i, base in enumerate(found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    return scan


def scan_secrets(docs: DataFrame, model: CharCNN | None = None, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, by start and then kind (assign, access, hex, model).  Model spans are
    candidates, which no base span touches; of one longer than INSIDE, the windows that the network finds, joined where
    they overlap.  A null text counts as empty and has none.  Null ids and repeated rows are
    scanned like any others; an empty table gives an empty result.  Other columns are not read.
    """
    model = model or train_model(docs, text_col=text_col, **how)
    rows = docs.select(F.col(id_col).cast("long"), text_of(text_col))
    return rows.mapInArrow(_scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
