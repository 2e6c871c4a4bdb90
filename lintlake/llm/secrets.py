"""Secret scans: rule findings, and a character convolutional network over every other candidate.

Rules: ``assign`` (a keyword, a sign and a value), ``access`` (AKIA keys) and ``hex`` (long lower-case hex).
Their findings always stay. Candidates are all runs of at least MIN_RUN characters that keys are
made of; each is read with the characters around it by the network, a run longer than its frame in overlapping
frames of which the most probable one counts. It is trained on labelled
findings: frames that show a rule's secret are positive, others negative; positives are also shown without
their keyword or in another alphabet, and ordinary words run together as negatives, so that the network learns
more than the rules.

Training begins on a bounded start, half of it taken where rules find something, so that a finding anywhere in the
table gives positives. Then every frame of every text is shown once: each task goes on from the start with its own
rows, and the weights of all tasks are averaged, each by its number of frames. A fifth of the positives is held out of
both. The threshold is calibrated on all of these, wherever they are: the highest one that keeps RECALL of them in both
dresses. A table that the start holds whole needs no second showing. Candidates at or above the threshold become findings of kind
``model``. The average depends on how rows are split into tasks; equal splits give an equal network.

Offsets are code points, ends exclusive. Null and empty texts have no findings. Repeated rows give equal
rows. With no labelled findings there is no network, and the rules stand alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Cheap conditions without which a pattern can't match.
_SIGN = re.compile(r"[:=]")
_KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: As short as the values of the rule ``assign``.
MIN_RUN = 8
BEFORE, BODY, AFTER = 24, 40, 8
WIDTH = BEFORE + BODY + AFTER
#: Documents, and labelled candidates of them, that training begins with at most.
TRAIN_DOCUMENTS = 4000
TRAIN_CANDIDATES = 6000
#: Frames that are held at once, and characters of the texts that are shown together in one step of training on all.
FRAMES = 8192
CHARACTERS = 1 << 18
#: Logit beyond which a frame of the table is right enough to move nothing.
MARGIN = 3.0
#: Frames of the start that are shown again in each of these steps, and the step's length.
REHEARSED = 64
RATE = 1e-3
#: Scores are counted in parts of 1 / SCALE for the threshold.
SCALE = 1 << 14
#: Positives in other dress, and made-up negatives, that are added to them.
VARIED = 2000
RECALL = 0.95
#: A text in which a rule's finding makes a candidate positive matches one of these; they are read by Spark.
_RULED = (_ASSIGN.pattern.rpartition("+)")[0] + "*[A-Za-z0-9+/_=-]{8})", "AKIA[A-Z0-9]{12}", _HEX.pattern)


def _keyword(text: str) -> bool:
    lower = text.lower()
    return any(k in lower for k in _KEYWORDS) and _SIGN.search(text) is not None


def rule_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' findings."""
    out = []
    if _keyword(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text)]


def secret_spans(text: str) -> list[tuple[int, int]]:
    """The secrets of the rules' findings, without their keywords; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for start, kind, end in rule_findings(text):
        start = _ASSIGN.match(text, start).start(2) if kind == 0 else start
        if out and start < out[-1][1]:
            start, end = out[-1][0], max(end, out.pop()[1])
        out.append((start, end))
    return out


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """Spans of at most BODY characters that cover a candidate, each half over the last one."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in [*range(start, end - BODY, BODY // 2), end - BODY]]


def window(text: str, start: int, end: int) -> str:
    """A piece's characters and those around it, in a fixed frame."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end].ljust(BODY, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def codes(windows: list[str]) -> np.ndarray:
    """Characters as numbers below ALPHABET: ASCII as it is, all others as one class."""
    points = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), WIDTH)
    return np.minimum(points, 128).astype(np.int32)


ALPHABET = 129
_RUN = np.array([bool(re.match("[A-Za-z0-9+/_=-]", chr(c))) for c in range(ALPHABET)])


class Layout:
    """Texts side by side as codes, and the pieces of all their candidates: ``candidates``, ``pieces`` and ``window`` for many at once.

    ``first`` is where each text begins; ``owner``, ``run`` (start, end) and ``piece`` (start, end) have a row for each piece.
    """

    def __init__(self, texts: list[str]):
        gap = "\0" * WIDTH
        points = np.frombuffer((gap + "".join(t + gap for t in texts)).encode("utf-32-le"), np.uint32)
        self.texts, self.points = texts, np.minimum(points, ALPHABET - 1).astype(np.uint8)
        self.first = WIDTH + np.cumsum([0] + [len(t) + WIDTH for t in texts])[:-1]
        edges = np.flatnonzero(np.diff(_RUN[self.points])) + 1
        start, end = edges[::2], edges[1::2]
        start, end = (x[end - start >= MIN_RUN] for x in (start, end))
        number = 1 + np.maximum(0, -((BODY - (end - start)) // (BODY // 2)))
        run = np.repeat(np.arange(len(start)), number)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
        self.run = np.column_stack([start[run], end[run]])
        a = np.minimum(self.run[:, 0] + nth * (BODY // 2), np.maximum(self.run[:, 0], self.run[:, 1] - BODY))
        self.piece = np.column_stack([a, np.minimum(a + BODY, self.run[:, 1])])
        self.owner = np.searchsorted(self.first, a, side="right") - 1

    def codes(self, rows: slice) -> np.ndarray:
        a, b = self.piece[rows].T
        out = np.empty((len(a), WIDTH), np.uint8)
        out[:, : BEFORE + BODY] = self.points[a[:, None] + np.arange(-BEFORE, BODY)]
        out[:, BEFORE : BEFORE + BODY][np.arange(BODY) >= (b - a)[:, None]] = 0
        out[:, BEFORE + BODY :] = self.points[b[:, None] + np.arange(AFTER)]
        return out

    def frame(self, row: int) -> str:
        text = self.owner[row]
        return window(self.texts[text], *(self.piece[row] - self.first[text]).tolist())

    def labels(self) -> np.ndarray:
        """Whether a piece shows at least MIN_RUN characters of a rule's secret."""
        out = np.zeros(len(self.owner))
        for i, text in enumerate(self.texts):
            found = secret_spans(text)
            if found:
                rows = slice(*np.searchsorted(self.owner, [i, i + 1]))
                a, b = (self.piece[rows] - self.first[i]).T
                start, end = np.array(found + [(len(text), len(text) + WIDTH)]).T
                k = np.searchsorted(end, a + MIN_RUN)
                out[rows] = np.minimum(b, end[k]) - np.maximum(a, start[k]) >= MIN_RUN
        return out


#: What of BODY is looked up for a run that leaves some padding in it.
NARROW = 23
#: The weights of a network.
NAMES = ("embed", "kernel", "bias", "out", "shift")


@dataclass
class Network:
    """Embedding, one convolution with ReLU, maxima over the three parts of the frame, a logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    threshold: float = 1.0

    span = 5
    parts = ((0, BEFORE), (BEFORE, BEFORE + BODY), (BEFORE + BODY - 4, WIDTH))

    def forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]
        n = x.shape[1] - self.span + 1
        unfolded = np.concatenate([e[:, k : k + n] for k in range(self.span)], axis=2)
        z = unfolded @ self.kernel + self.bias
        pooled, at = [], []
        for a, b in self.parts:
            part = z[:, a : min(b, n)]
            where = part.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(part, where[:, None], 1)[:, 0], 0))
            at.append(where + a)
            pooled.append(np.maximum(part, 0).mean(axis=1))
        h = np.concatenate(pooled, axis=1)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.shift, -30, 30)))
        return unfolded, z, at, h, p

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each pair of characters gives at places 0 and 1, and 2 and 3, of the convolution, and each one at place 4."""
        one = [self.embed @ self.kernel[k * self.embed.shape[1] : (k + 1) * self.embed.shape[1]] for k in range(self.span)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(ALPHABET**2, -1).astype(np.float32)
        return pair(one[0], one[1]), pair(one[2], one[3]), (one[4] + self.bias).astype(np.float32)

    def logits(self, x: np.ndarray, tables: tuple) -> np.ndarray:
        """``forward`` without what training needs, by looking up the products; padding behind a short run is counted, not looked up."""
        first, second, last = tables
        padding = np.maximum(first[0] + second[0] + last[0], 0)
        short = np.count_nonzero(x[:, BEFORE : BEFORE + BODY], axis=1) <= NARROW - self.span
        kept = np.r_[0 : BEFORE + NARROW, BEFORE + BODY : WIDTH]
        out = np.empty(len(x))
        for rows, body, columns in ((np.flatnonzero(short), NARROW, kept), (np.flatnonzero(~short), BODY, np.arange(WIDTH))):
            for at in (rows[i : i + 128] for i in range(0, len(rows), 128)):
                c = np.ascontiguousarray(x[at][:, columns].T, dtype=np.intp)  # places first: sums and maxima run over whole rows
                pairs = c[:-1] * ALPHABET + c[1:]
                n = len(c) - self.span + 1
                z = first.take(pairs[:n], axis=0)
                z += second.take(pairs[2 : 2 + n], axis=0)
                z += last.take(c[4:], axis=0)
                np.maximum(z, 0, out=z)
                before, run, after = z[:BEFORE], z[BEFORE : BEFORE + body], z[BEFORE + body - 4 :]
                inside = (run.sum(axis=0) + (BODY - body) * padding) / BODY
                h = np.concatenate([before.max(axis=0), before.mean(axis=0), run.max(axis=0), inside, after.max(axis=0), after.mean(axis=0)], axis=1)
                out[at] = h @ self.out + self.shift
        return out

    def probability(self, frames: list[str] | np.ndarray, tables: tuple | None = None) -> np.ndarray:
        """Of frames or their codes."""
        x = frames if isinstance(frames, np.ndarray) else codes(frames)
        return 1 / (1 + np.exp(-np.clip(self.logits(x, tables or self.tables()), -30, 30)))

    def weights(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, name)) for name in NAMES])

    def with_weights(self, flat: np.ndarray) -> Network:
        sizes = [np.size(getattr(self, name)) for name in NAMES]
        parts = np.split(np.asarray(flat, float), np.cumsum(sizes)[:-1])
        own = {name: part.reshape(np.shape(getattr(self, name))) for name, part in zip(NAMES, parts, strict=True)}
        return replace(self, **own | {"shift": float(own["shift"])})


class Descent:
    """Adam on a network's weights, which it changes in place."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.steps = net, rate, 0
        self.first, self.second = ({k: np.zeros_like(np.asarray(getattr(net, k), float)) for k in NAMES} for _ in range(2))

    def step(self, x: np.ndarray, slope: Callable[[np.ndarray, slice], np.ndarray]) -> None:
        """``slope`` gives the loss's derivative by the logits of some rows, from their probabilities. Memory doesn't grow with the rows."""
        parts = [slice(i, i + 512) for i in range(0, len(x), 512)]
        grads = self.gradients(x[parts[0]], lambda p: slope(p, parts[0]))
        for rows in parts[1:]:
            more = self.gradients(x[rows], lambda p, rows=rows: slope(p, rows))
            grads = {name: grads[name] + more[name] for name in NAMES}
        self.steps += 1
        for name in NAMES:
            g = grads[name]
            self.first[name] = 0.9 * self.first[name] + 0.1 * g
            self.second[name] = 0.999 * self.second[name] + 0.001 * g**2
            move = self.rate * (self.first[name] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[name] / (1 - 0.999**self.steps)) + 1e-8)
            setattr(self.net, name, getattr(self.net, name) - move)

    def gradients(self, x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray]) -> dict:
        net, size = self.net, self.net.embed.shape[1]
        unfolded, z, at, h, p = net.forward(x)
        d = slope(p)
        grads = {"out": h.T @ d, "shift": d.sum()}
        dh = d[:, None] * net.out
        dz = np.zeros_like(z)
        every = np.arange(len(x))[:, None]
        f = net.bias.size
        for k, (a, b) in enumerate(net.parts):
            top = dh[:, 2 * k * f : (2 * k + 1) * f] * (h[:, 2 * k * f : (2 * k + 1) * f] > 0)
            np.add.at(dz, (every, at[k], np.arange(f)), top)
            part = slice(a, min(b, z.shape[1]))
            dz[:, part] += dh[:, None, (2 * k + 1) * f : (2 * k + 2) * f] * (z[:, part] > 0) / (part.stop - part.start)
        grads["bias"] = dz.sum(axis=(0, 1))
        grads["kernel"] = np.tensordot(unfolded, dz, ((0, 1), (0, 1)))
        du = dz @ net.kernel.T
        de = np.zeros_like(net.embed)
        for k in range(net.span):
            np.add.at(de, x[:, k : k + z.shape[1]], du[:, :, k * size : (k + 1) * size])
        grads["embed"] = de
        return grads


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that make both labels count alike."""
    return np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 10, filters: int = 16, size: int = 8, rate: float = 3e-3) -> Network:
    """Adam on the logistic loss with balanced classes; the seed is fixed, so equal rows give an equal network."""
    rng = np.random.default_rng(3)
    net = Network(rng.normal(0, 0.3, (ALPHABET, size)), rng.normal(0, 0.15, (Network.span * size, filters)), np.zeros(filters), rng.normal(0, 0.1, 6 * filters), 0.0)
    descent, weight = Descent(net, rate), balanced(y)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for rows in (order[i : i + 64] for i in range(0, len(order), 64)):
            descent.step(x[rows], lambda p, part, rows=rows: (p - y[rows[part]]) * weight[rows[part]] / len(rows))
    return net


_SIGNED = ("pwd", "pass", "auth", "credential", "access", "login", "private")
_WORD_LIST = ("user", "name", "value", "const", "config", "id", "ref", "hash", "key", "data", "item", "page")


def _varied(frame: str, label: int, rng: np.random.Generator) -> str:
    """A labelled frame in other dress: a positive without its keyword, or in base 64, or in capitals."""
    before, body, after = frame[:BEFORE], frame[BEFORE : BEFORE + BODY], frame[BEFORE + BODY :]
    if label and rng.random() < 0.5:
        before = _named(rng, (_WORD_LIST, _SIGNED)[rng.integers(2)])
    if label and rng.random() < 0.5:
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        alphabet = (alphabet, alphabet + "+/", alphabet[:26] + alphabet[52:])[rng.integers(3)]
        body = "".join(alphabet[rng.integers(len(alphabet))] if c != "\0" else c for c in body)
    if label and rng.random() < 0.7:
        body = body.rstrip("\0")[: int(rng.integers(MIN_RUN, (2 * MIN_RUN, BODY + 1)[rng.integers(2)]))].ljust(BODY, "\0")
    if label and rng.random() < 0.5:
        after = (("", '";', "\n", " ", "',", ")")[rng.integers(6)] + _prose(rng, AFTER))[:AFTER]
    if label and rng.random() < 0.3:  # inside a long run, of which a frame shows some part
        key, joint = body.rstrip("\0"), "/=_-"[rng.integers(4)]
        run = _chain(rng, joint, 80) + joint + key + joint + _chain(rng, joint, 60)
        at = 81 - int(rng.integers(0, 28))
        return run[at - BEFORE : at + BODY + AFTER]
    return before + body + after


def _word(rng: np.random.Generator) -> str:
    return "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, rng.integers(3, 9)))


def _prose(rng: np.random.Generator, length: int) -> str:
    return _chain(rng, " ", length)


def _named(rng: np.random.Generator, names: tuple[str, ...]) -> str:
    """What precedes a value: a name and a sign, after some words or at the start of a text."""
    name = names[rng.integers(len(names))] + (' = "', ": ", "=", " ")[rng.integers(4)]
    return (("" if rng.random() < 0.2 else _prose(rng, BEFORE) + " ") + name)[-BEFORE:].rjust(BEFORE, "\0")


def _chain(rng: np.random.Generator, joint: str, length: int) -> str:
    return joint.join(_word(rng) for _ in range(length // 3 + 1))[:length]


def _ordinary(rng: np.random.Generator) -> str:
    """A negative: words run together, numbers, rulers and paths, as prose and markup hold them, also parts of long ones."""
    pick = rng.integers(6)
    word = lambda: _word(rng)
    if pick == 5:
        return _chain(rng, "/=_-"[rng.integers(4)], WIDTH)
    if pick == 0:
        body = "".join(str(d) for d in rng.integers(0, 10, rng.integers(MIN_RUN, 24)))
    elif pick == 1:
        body = "-_="[rng.integers(3)] * int(rng.integers(MIN_RUN, 40))
    else:
        joint = ("", "-", "_", "/")[rng.integers(4)]
        body = joint.join((word().title() if pick == 3 else word()) for _ in range(8))[: int(rng.integers(MIN_RUN, (2 * MIN_RUN, 41)[rng.integers(2)]))]
        body = body.upper() if rng.random() < 0.2 else body
    before = _named(rng, (_WORD_LIST, _SIGNED)[rng.integers(2)]) if rng.random() < 0.4 else (_prose(rng, BEFORE) + " ")[-BEFORE:]
    return before + body.ljust(BODY, "\0") + ((" ", ". ", ", ", "\n", '"')[rng.integers(5)] + _prose(rng, AFTER))[:AFTER]


def fit(docs: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> Network | None:
    """The network, begun on a bounded number of documents, chosen by a hash of the id, and trained on all of them."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for layout in _layouts(text.as_py() for batch in batches for text in batch.column("text")):
            yield pa.record_batch({"frame": pa.array([layout.frame(i) for i in range(len(layout.owner))], pa.string()), "label": pa.array(layout.labels(), pa.int32(), safe=False)})

    lower = F.lower("text")
    keyword = F.lit(False)
    for word in _KEYWORDS:
        keyword = keyword | lower.contains(word)
    ruled = (keyword & F.col("text").rlike("(?i)" + _RULED[0])) | F.col("text").rlike(_RULED[1]) | F.col("text").rlike(_RULED[2])
    possible = docs.where(F.col("text").rlike(f"[A-Za-z0-9+/_=-]{{{MIN_RUN}}}")).select(F.xxhash64("doc_id", "text").alias("h"), ruled.alias("ruled"), "text")
    keys = stored(possible.select("h", "ruled"), "secret-keys")
    number = {r.ruled: r.n for r in keys.groupBy("ruled").agg(F.count("*").alias("n")).collect()}
    if not number.get(True):
        return None
    most = {True: max(1, max_documents // 2), False: max_documents // 2}
    part = lambda which: keys.where(F.col("ruled") == which).select("h").orderBy("h").limit(most[which])
    start = possible.join(F.broadcast(part(True).union(part(False)).distinct()), "h").mapInArrow(label, "frame string, label int")
    frames = stored(start.groupBy("frame").agg(F.max("label").alias("label")), "secret-start")
    first = lambda label, n: [r.frame for r in frames.where(F.col("label") == label).orderBy(F.xxhash64("frame"), "frame").limit(n).collect()]
    positives, negatives = first(1, TRAIN_CANDIDATES // 2), first(0, TRAIN_CANDIDATES // 2)
    rng = np.random.default_rng(11)
    tests = positives[4::5] or positives  # too few to hold some out
    shown = [f for i, f in enumerate(positives) if i % 5 != 4]
    times = max(1, min(20, VARIED // len(shown)))
    learn = [(f, 1.0) for f in shown] + [(f, 0.0) for f in negatives]
    learn += [(_varied(f, 1, rng), 1.0) for f in shown for _ in range(times)] + [(_ordinary(rng), 0.0) for _ in range(VARIED)]
    x, y = codes([f for f, _ in learn]), np.array([v for _, v in learn])
    net = train(x, y)
    if all(number.get(which, 0) <= most[which] for which in most) and max(len(positives), len(negatives)) < TRAIN_CANDIDATES // 2:
        net.threshold = recall_threshold(net.probability(tests + [_varied(f, 1, rng) for f in tests for _ in range(2)]))
        return net
    net, held_out = train_on_all(docs, net, x, y, frozenset(shown), frozenset(tests))
    net.threshold = threshold_of_all(held_out, net)
    return net


def _dresses(frame: str, number: int = 2) -> list[str]:
    """A positive in other dresses, the same ones wherever it is met."""
    rng = np.random.default_rng(zlib.crc32(frame.encode()))
    return [_varied(frame, 1, rng) for _ in range(number)]


def train_on_all(docs: DataFrame, start: Network, x: np.ndarray, y: np.ndarray, shown: frozenset[str], tests: frozenset[str]) -> tuple[Network, DataFrame]:
    """The start trained on every frame of every text, and the frames of all positives that were held out.

    The loss is the start's, both labels counting alike, but a frame that is right by MARGIN has no slope. Each step also
    shows the positives' dresses and some frames (``x``, ``y``) of the start. ``shown`` and ``tests`` are the positives on which it was trained and
    those that were held out of it; of others, a fifth is.
    """
    again = balanced(y) / REHEARSED

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = replace(start)
        descent, rng, seen = Descent(net, RATE), np.random.default_rng(5), 0
        for layout in _layouts(text.as_py() for batch in batches for text in batch.column("text")):
            labels = layout.labels()
            ones = [(int(i), layout.frame(i)) for i in np.flatnonzero(labels)]
            held = {f for _, f in ones if f in tests or (f not in shown and zlib.crc32(f.encode()) % 5 == 4)}
            yield pa.record_batch({"at": pa.nulls(len(held), pa.int32()), "value": pa.nulls(len(held), pa.float64()), "frame": pa.array(sorted(held), pa.string())})
            kept = np.ones(len(labels), bool)
            kept[[i for i, f in ones if f in held and f not in shown]] = False
            frames, tables = [np.empty((0, WIDTH), np.uint8)], net.tables()
            near = [np.empty(0, np.int64)]
            for rows in (slice(i, i + FRAMES) for i in range(0, len(labels), FRAMES)):
                part = layout.codes(rows)
                side = np.where(labels[rows] == 1, 1, -1) * net.logits(part, tables)
                moving = np.flatnonzero((side < MARGIN) & kept[rows])
                frames.append(part[moving])
                near.append(moving + rows.start)
            extra = codes([d for i, f in ones if kept[i] for d in _dresses(f)])
            old = rng.integers(0, len(x), REHEARSED)
            own = np.concatenate([labels[np.concatenate(near)], np.ones(len(extra))])
            many = [max(1, (kept & (labels == 0)).sum()), max(1, (kept & (labels == 1)).sum() + len(extra))]
            target = np.concatenate([own, y[old]])
            weight = np.concatenate([np.where(own == 1, 0.5 / many[1], 0.5 / many[0]), again[old]])
            descent.step(np.concatenate([*frames, extra, x[old]]), lambda p, rows, target=target, weight=weight: (p - target[rows]) * weight[rows])
            seen += int(kept.sum())
        if seen:
            flat = np.append(net.weights(), 1.0) * seen
            yield pa.record_batch({"at": pa.array(np.arange(len(flat)), pa.int32()), "value": pa.array(flat), "frame": pa.nulls(len(flat), pa.string())})

    out = stored(docs.select("text").mapInArrow(learn, "at int, value double, frame string"), "secret-training")
    total = {r["at"]: r["value"] for r in out.where("at IS NOT NULL").groupBy("at").agg(F.sum("value").alias("value")).collect()}
    flat = np.array([total[i] for i in range(len(total))])
    return start.with_weights(flat[:-1] / flat[-1]), out.where("frame IS NOT NULL").select("frame").distinct()


def _layouts(texts: Iterable[str | None]) -> Iterator[Layout]:
    """All texts in their order, about CHARACTERS at a time."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHARACTERS:
            yield Layout(held)
            held, size = [], 0
    if size:
        yield Layout(held)


def threshold_of_all(held_out: DataFrame, net: Network) -> float:
    """``recall_threshold`` of all these frames and twice as many dresses, in parts of 1 / SCALE; scores are counted where they are.

    A dress is drawn by chance, so few frames are shown in more of them and count more often.
    """
    times = max(1, min(10, VARIED // max(1, 2 * held_out.count())))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            frames = [d for f in batch.column("frame").to_pylist() for d in [f] * times + _dresses(f, 2 * times)]
            yield pa.record_batch({"part": pa.array((net.probability(frames, tables) * SCALE).astype(np.int32), pa.int32())})

    counts = sorted(held_out.mapInArrow(score, "part int").groupBy("part").agg(F.count("*").alias("n")).collect())
    place = np.cumsum([r.n for r in counts])
    return counts[int(np.searchsorted(place, int((1 - RECALL) * place[-1]), side="right"))].part / SCALE


def recall_threshold(scores: np.ndarray) -> float:
    """The highest threshold that at least RECALL of the positives' scores reach."""
    return float(np.sort(scores)[int((1 - RECALL) * len(scores))])


def scan(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, findings: all findings of every text in order of start and kind."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part.column("text").to_pylist()
                found, done = [rule_findings(text or "") for text in texts], 0
                for layout in _layouts(texts if network else []):
                    for rows in (slice(i, i + FRAMES) for i in range(0, len(layout.owner), FRAMES)):
                        hits = rows.start + np.flatnonzero(network.probability(layout.codes(rows), tables) >= network.threshold)
                        owner = layout.owner[hits]
                        for i, (a, b) in zip((done + owner).tolist(), (layout.run[hits] - layout.first[owner, None]).tolist(), strict=True):
                            if (a, 3, b) not in found[i][-1:] and not any(s <= a and b <= e for s, k, e in found[i] if k < 3):
                                found[i].append((a, 3, b))
                    done += len(layout.texts)
                rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)] for spans in found]
                yield pa.record_batch({"doc_id": part.column("doc_id").cast(pa.int64()), "findings": pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))})

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, findings array<struct<kind: string, start: int, end: int>>")


def findings(docs: DataFrame, max_documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.filter("findings", lambda x: x["kind"] == kind)
    joined = lambda rows: F.concat_ws(",", F.transform(rows, one))
    base = F.filter("findings", lambda x: x["kind"] != "model")
    return scan(docs, fit(docs, max_documents)).select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"),
    )
