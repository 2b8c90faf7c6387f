"""LM scoring: a log-bilinear model trained by noise-contrastive estimation, beside add-one unigram scores."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, materialise

#: What stands for a text's end among hashed words: the hash of a line feed, which no word holds.
END = xxhash.xxh64_intdigest(b"\n")


def tokens(text: str | None) -> np.ndarray:
    """XXH64 of each of a text's words (A-Z lower-cased) and of its end."""
    words = text.encode().lower().split() if text else []
    return np.fromiter(chain(map(xxhash.xxh64_intdigest, words), (END,)), np.uint64, len(words) + 1)


@dataclass
class Vocabulary:
    """The model's symbols: each of the commonest words, then ``classes`` classes of all other words by hash.

    ``hashes`` is sorted; ``symbol`` is each one's number. ``noise`` is the share of every symbol in training.
    """

    hashes: np.ndarray
    symbol: np.ndarray
    noise: np.ndarray
    classes: int

    @property
    def size(self) -> int:
        return len(self.hashes) + self.classes

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = (len(self.hashes) + (hashes >> np.uint64(32)) % np.uint64(self.classes)).astype(np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.symbol[at[known]]
        return out


class LogBilinear:
    """score(w | a, b) = (C1 * R[a] + C2 * R[b]) . Q[w] + bias[w], with a and b the two symbols before w.

    Beside the symbols stand clusters (symbol mod their number, about its square root) with vectors of their own, so that a
    probability is a cluster's softmax times one within the cluster: its cost grows with the root of the vocabulary.

    One more row of R stands before a text. Biases start at the noise distribution's logarithms and vectors near zero, so an
    untrained model is the unigram model.
    """

    def __init__(self, noise: np.ndarray, width: int = 16, seed: int = 7):
        rng, n = np.random.default_rng(seed), len(noise)
        self.noise, self.start, self.clusters = noise, n, max(1, math.isqrt(n))
        share = np.bincount(np.arange(n) % self.clusters, noise, self.clusters)
        self.params = [
            rng.normal(0, 0.1, (n + 1, width)).astype(np.float32),
            rng.normal(0, 0.1, (n, width)).astype(np.float32),
            np.log(noise).astype(np.float32),
            np.ones((2, width), np.float32),
            rng.normal(0, 0.1, (self.clusters, width)).astype(np.float32),
            np.log(share).astype(np.float32),
        ]
        self.squares = [np.full_like(p, 1e-3) for p in self.params]
        self.rng, self.trained = rng, 0

    def contexts(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[self.start], symbols[:-1]]), np.concatenate([[self.start, self.start], symbols[:-2]])[: len(symbols)]

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, k: int = 32, rate: float = 0.2) -> None:
        """One Adagrad step on a batch: each token, and its cluster, against ``k`` noise draws for the whole batch.

        Only the rows that the batch meets are touched, so a step's cost does not depend on the vocabulary.
        """
        r, q, bias, c, cq, cbias = self.params
        ra, rb = r[a], r[b]
        hidden = c[0] * ra + c[1] * rb
        drawn = np.searchsorted(self.cumulative, self.rng.random(k)).astype(np.int32)
        g_q, g_bias, at_q, g_hidden = self._contrast(hidden, w, drawn, q, bias, self.log_noise)
        g_cq, g_cbias, at_cq, g_more = self._contrast(hidden, w % self.clusters, drawn % self.clusters, cq, cbias, self.log_share)
        g_hidden += g_more
        at_r, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        g_r = _gather(inverse, np.concatenate([g_hidden * c[0], g_hidden * c[1]]), len(at_r))
        g_c = np.stack([(g_hidden * ra).sum(0), (g_hidden * rb).sum(0)])
        each = (at_r, g_r), (at_q, g_q), (at_q, g_bias), (slice(None), g_c), (at_cq, g_cq), (at_cq, g_cbias)
        for p, s, (at, g) in zip(self.params, self.squares, each, strict=True):
            g = (g / len(w)).astype(np.float32)
            s[at] += g * g
            p[at] -= rate * g / np.sqrt(s[at])
        self.trained += len(w)

    @staticmethod
    def _contrast(hidden, w, drawn, q, bias, log_noise):
        """Gradients of the targets' rows of vectors and biases, which rows, and those of ``hidden``."""
        logs = log_noise + np.float32(math.log(len(drawn)))
        data = np.einsum("ij,ij->i", hidden, q[w]) + bias[w] - logs[w]
        fake = hidden @ q[drawn].T + (bias[drawn] - logs[drawn])
        e_data = (-1 / (1 + np.exp(np.clip(data, -30, 30)))).astype(np.float32)
        e_fake = (1 / (1 + np.exp(-np.clip(fake, -30, 30)))).astype(np.float32)
        rows, inverse = np.unique(np.concatenate([w, drawn]), return_inverse=True)
        g_q = _gather(inverse, np.concatenate([e_data[:, None] * hidden, e_fake.T @ hidden]), len(rows))
        g_bias = np.bincount(inverse, np.concatenate([e_data, e_fake.sum(0)]), len(rows))
        return g_q, g_bias, rows, e_data[:, None] * q[w] + e_fake @ q[drawn]

    def prepare(self) -> None:
        self.cumulative, self.log_noise = np.cumsum(self.noise / self.noise.sum()), np.log(self.noise).astype(np.float32)
        self.cumulative[-1] = 1
        self.log_share = np.log(np.bincount(np.arange(len(self.noise)) % self.clusters, self.noise, self.clusters)).astype(np.float32)

    def log_probs(self, w: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 1 << 15, block: int = 1 << 9) -> np.ndarray:
        """Natural logarithms of P(cluster of w | a, b) * P(w | its cluster, a, b), each an exact softmax."""
        r, q, bias, c, cq, cbias = self.params
        out, n = np.empty(len(w)), self.clusters

        def picked(scores, at):
            """Logs of softmaxes at some places; sums that leave the range of the numbers are taken from the maxima down."""
            found = scores.take(np.arange(0, scores.size, scores.shape[1]) + at)
            with np.errstate(over="ignore"):
                sums = np.exp(scores) @ np.ones(scores.shape[1], np.float32)
            lost = ~((sums > 1e-30) & (sums < 1e30))
            logs = np.log(np.where(lost, 1, sums))
            if lost.any():
                top = scores[lost].max(1, keepdims=True)
                logs[lost] = np.log(np.exp(scores[lost] - top).sum(1)) + top[:, 0]
            return found - logs

        # One more column of ones carries the biases through the product; tokens go in the order of their clusters.
        near, far = c[0] * r, c[1] * r
        cq, members = np.vstack([cq.T, cbias]), [np.vstack([q[k::n].T, bias[k::n]]) for k in range(n)]
        for lo in range(0, len(w), chunk):
            part = slice(lo, lo + chunk)
            own = w[part] % n
            order = np.argsort(own.astype(np.uint16) if n <= 1 << 16 else own, kind="stable")
            own, within = own[order], w[part][order] // n
            hidden = np.ones((len(own), q.shape[1] + 1), np.float32)
            np.add(near.take(a[part][order], 0), far.take(b[part][order], 0), out=hidden[:, :-1])
            logs = np.empty(len(own))
            for i in range(0, len(own), block):
                logs[i : i + block] = picked(hidden[i : i + block] @ cq, own[i : i + block])
            bounds = np.searchsorted(own, np.arange(n + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                i, j = bounds[k], bounds[k + 1]
                logs[i:j] += picked(hidden[i:j] @ members[k], within[i:j])
            out[lo + order] = logs
        return out


def _gather(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, j], size) for j in range(rows.shape[1])], 1)


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in arrays]).astype(np.float32)


def _unflat(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([x.size for x in like])[:-1]
    return [part.reshape(x.shape).copy() for part, x in zip(np.split(flat, cuts), like, strict=True)]


def _mean(table):
    """The mean of some replicas, each parameter weighted by the squared gradients it has met; what none has met stays."""
    import pyarrow as pa

    total, params, learnt = 0.0, 0.0, 0.0
    for p, g in sorted(zip(table["params"].to_pylist(), table["gained"].to_pylist(), strict=True)):  # one order, so one sum
        p, g = (np.frombuffer(x, np.float32).astype(np.float64) for x in (p, g))
        w = g + 1e-12
        total, params, learnt = total + w, params + w * p, learnt + w * g
    out = [(x / total).astype(np.float32).tobytes() for x in (params, learnt)]
    return pa.table({"part": table["part"][:1], "params": pa.array(out[:1], pa.binary()), "gained": pa.array(out[1:], pa.binary())})


def train(docs: DataFrame, vocabulary: Vocabulary, total: int, width: int = 16, batch: int = 4096, least: int = 1 << 20, piece: int = 1 << 14) -> LogBilinear:
    """The model after rounds of parallel training over all texts of ``row_hash, text``, ``total`` tokens.

    Rows are dealt to rounds and, within a round, to replicas by their hash alone, and a replica takes them in the order of the
    hash: the model does not depend on how the input is partitioned. Rounds grow with the logarithm of the tokens. A replica
    takes about ``least`` tokens, or four for each parameter where these are more, so the replicas of a round grow with
    the tokens and what they hand over stays in proportion to what they read. Replicas start from the round's model and are averaged
    piece by piece: no task holds more than ``piece`` parameters of every replica, and the driver receives one model a round.
    """
    spark = docs.sparkSession
    model = LogBilinear(vocabulary.noise, width)
    rounds = max(1, (total >> 21).bit_length())
    replicas = max(1, math.ceil(total / rounds / max(least, 4 * sum(p.size for p in model.params))))
    sent = spark.sparkContext.broadcast(vocabulary)

    def read(rows):
        import pyarrow as pa

        each = [sent.value.symbols(tokens(t)) for t in rows["text"].to_pylist()]
        return {"row_hash": rows["row_hash"], "round": rows["round"], "symbols": pa.ListArray.from_arrays(np.cumsum([0, *map(len, each)], dtype=np.int32), np.concatenate(each))}

    in_round = F.pmod(F.xxhash64("row_hash", F.lit(1)), F.lit(rounds)).cast("int").alias("round")
    dealt = materialise(batches(docs.select("row_hash", "text", in_round), read, "row_hash long, round int, symbols array<int>"), "symbols", by="round")

    for turn in range(rounds):
        state = spark.sparkContext.broadcast((model.params, model.squares))

        def fit(it, turn=turn, state=state):
            """One model per replica of the partition, whose rows come replica by replica."""
            import pyarrow as pa

            names = pa.schema([("part", pa.int64()), ("params", pa.binary()), ("gained", pa.binary())])

            def learn(rest: list, last: bool):
                w, a, b = (np.concatenate(x) for x in zip(*rest, strict=True))
                stop = len(w) if last else len(w) - len(w) % batch
                for lo in range(0, stop, batch):
                    own.step(w[lo : lo + batch], a[lo : lo + batch], b[lo : lo + batch])
                rest[:] = [(w[stop:], a[stop:], b[stop:])]

            def told():
                if rest:
                    learn(rest, True)
                params, gained = _flat(own.params), _flat(own.squares) - _flat(state.value[1])
                for part, lo in enumerate(range(0, len(params), piece)):
                    yield pa.RecordBatch.from_pylist([{"part": part, "params": params[lo : lo + piece].tobytes(), "gained": gained[lo : lo + piece].tobytes()}], names)

            now, rest, waiting = None, [], 0
            for rows in it:
                lists = rows["symbols"]
                ends = lists.offsets.to_numpy()
                for replica, s in zip(rows["replica"].to_pylist(), np.split(lists.flatten().to_numpy(), ends[1:-1] - ends[0]), strict=True):
                    if replica != now:
                        if now is not None:
                            yield from told()
                        own = LogBilinear(sent.value.noise, width, seed=7 + turn)
                        own.params, own.squares = ([x.copy() for x in part] for part in state.value)
                        own.prepare()
                        now, rest, waiting = replica, [], 0
                    rest.append((s, *own.contexts(s)))
                    waiting += len(s)
                    if waiting > 64 * batch:
                        learn(rest, False)
                        waiting = len(rest[0][0])
            if now is not None:
                yield from told()

        schema = "part long, params binary, gained binary"
        replica = F.pmod(F.xxhash64("row_hash", F.lit(2)), F.lit(replicas)).cast("int").alias("replica")
        mine = dealt.where(F.col("round") == turn).select(replica, "row_hash", "symbols").repartition(replicas, "replica").sortWithinPartitions("replica", "row_hash")
        found = materialise(mine.mapInArrow(fit, schema), "replicas")
        rows = sorted(found.groupBy("part").applyInArrow(_mean, schema).collect(), key=lambda r: r["part"])
        if rows:
            params, gained = (np.concatenate([np.frombuffer(r[c], np.float32) for r in rows]) for c in ("params", "gained"))
            model.squares = [s + g for s, g in zip(model.squares, _unflat(gained, model.squares), strict=True)]
            model.params = _unflat(params, model.params)
        state.destroy()
    return model


def _commonest(counts: DataFrame, most: int) -> list:
    """At most ``most`` of the rows ``h, c``, the commonest first: whole bands of counts, and a hash share of the next band.

    A histogram over bands of counts, of a few hundred rows, sets the bounds, so that no more than ``most`` rows travel.
    """
    band = F.floor(8 * F.log2(F.col("c").cast("double"))).cast("int")
    seen = sorted(((r["band"], r["n"]) for r in counts.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room, floor_ = most, None
    for b, n in seen:
        if n > room:
            floor_ = b
            break
        room -= n
    keep = F.lit(True)
    if floor_ is not None:
        share = int(0.9 * room / dict(seen)[floor_] * (1 << 20)) if room > 1000 else 0
        keep = (band > floor_) | ((band == floor_) & (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share))
    rows = counts.where(keep).limit(most).collect()
    return sorted(rows, key=lambda r: (-r["c"], r["h"]))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, words: int | None = None, classes: int | None = None, head: int = 65_536) -> DataFrame:
    """Scores of every text, learnt from the texts whose ``crc32(id as text) mod folds`` is not ``held_fold``.

    Returns one row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Tokens are words
    (between ASCII white space, A-Z lower-cased) and one end. ``base_score`` is the add-one unigram log10 probability.
    ``score`` is the log-bilinear model's: log10 of the softmax over its symbols given the two symbols before, and for a word
    of a class, of its add-one share of the class. The symbols are the ``words`` commonest words, by default the number of different
    words to the power 2/3 (1,000 at least), and ``classes`` of the others, by default its root (32 at least): both grow with
    the texts. With the one unseen word that each class provides for, a text's
    probabilities sum to one.

    Null and empty texts are one end token. A null id reads as empty text, so it is in training. Without training texts the
    counts are zero and the model is uniform. Rows that share an id are scored each. Other columns are not read.

    Words are counted by XXH64 over all training texts. The commonest counts, ``head`` at most, are broadcast; the
    counts of all other words meet the texts by a join on the hash, pre-aggregated per text. Nothing depends on how many
    different words there are.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold == held_fold).alias("held_out"))
    training = docs.where(~F.col("held_out")).select(F.xxhash64(F.col("doc_id").cast("string"), "text").alias("row_hash"), "text")

    def count(it):
        import pyarrow as pa

        most, hashes, n = 4_000_000, [], 0

        def flush():
            h, c = np.unique(np.concatenate(hashes), return_counts=True)
            hashes.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["h", "c"])

        for rows in it:
            for text in rows["text"].to_pylist():
                hashes.append(tokens(text))
                n += len(hashes[-1])
                if n > most:
                    yield flush()
                    n = 0
        if hashes:
            yield flush()

    counts = training.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = materialise(counts, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if words is None:
        words = max(1000, math.ceil(distinct ** (2 / 3)))
    if classes is None:
        classes = max(32, math.isqrt(words))
    top = _commonest(counts, max(head, words))
    top_h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    top_c = np.array([r["c"] for r in top], np.int64)

    own = min(words, len(top))
    by_hash = np.argsort(top_h[:own])
    in_class = F.pmod(F.shiftrightunsigned("h", 32), F.lit(classes)).alias("class")
    sums = {r["class"]: (r["c"], r["n"]) for r in counts.groupBy(in_class).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    class_c = np.array([sums.get(k, (0, 0))[0] for k in range(classes)], np.float64)
    class_n = np.array([sums.get(k, (0, 0))[1] for k in range(classes)], np.float64)
    own_class = ((top_h[:own] >> np.uint64(32)) % np.uint64(classes)).astype(np.int64)
    class_c -= np.bincount(own_class, top_c[:own], classes)
    class_n -= np.bincount(own_class, minlength=classes)
    noise = np.concatenate([top_c[:own], class_c]) + 1.0
    vocabulary = Vocabulary(top_h[:own][by_hash], by_hash.astype(np.int32), noise / noise.sum(), classes)
    model = train(training, vocabulary, int(total))
    model.squares = None

    order = np.argsort(top_h)
    spread = np.log10(class_c + class_n + 1)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, model, top_h[order], np.log10(top_c[order] + 1.0), spread))

    def score(batch):
        vocab, model, head_h, head_log, spread = sent.value
        out = {k: [] for k in ("n_tokens", "known", "logs", "symbols", "tail_h", "tail_n")}
        waiting, held, scores = [], 0, []

        def flush():
            parts = model.log_probs(*(np.concatenate(x) for x in zip(*waiting, strict=True))) / math.log(10)
            scores.append(np.add.reduceat(parts, np.cumsum([0, *(len(x[0]) for x in waiting[:-1])])))
            waiting.clear()

        for text in batch["text"].to_pylist():
            h, inverse, n = np.unique(tokens(text), return_inverse=True, return_counts=True)
            symbols = vocab.symbols(h)
            if len(head_h):
                at = np.minimum(np.searchsorted(head_h, h), len(head_h) - 1)
                known = head_h[at] == h
            else:
                at, known = np.zeros(len(h), int), np.zeros(len(h), bool)
            logs = np.where(known, head_log[at] if len(head_h) else 0, 0)
            w = symbols[inverse]
            waiting.append((w, *model.contexts(w)))
            held += len(w)
            if held > 1 << 17:
                flush()
                held = 0
            listed = symbols < len(vocab.hashes)
            within = np.where(listed, 0, logs - spread[np.where(listed, 0, symbols - len(vocab.hashes))])
            out["n_tokens"].append(len(w))
            out["known"].append(int(n[known].sum()))
            out["logs"].append(float((n * logs).sum()))
            out["symbols"].append(float((n * within).sum()))
            out["tail_h"].append(h[~known].view(np.int64))
            out["tail_n"].append(n[~known])
        if waiting:
            flush()
        out["symbols"] = np.array(out["symbols"]) + np.concatenate(scores)
        return out | {"doc_id": batch["doc_id"], "held_out": batch["held_out"]}

    kind = dict(docs.dtypes)["doc_id"]
    scored = batches(docs, score, f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, symbols double, tail_h array<long>, tail_n array<long>")
    scored = materialise(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    tail = scored.select("row", F.explode(F.arrays_zip("tail_h", "tail_n")).alias("x")).select("row", F.col("x.tail_h").alias("h"), F.col("x.tail_n").alias("n"))
    tail = tail.join(counts, "h").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    out = scored.drop("tail_h", "tail_n").join(tail, "row", "left").na.fill(0, ["more", "more_logs"])
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("symbols") + F.col("more_logs")).alias("score"),
    )
