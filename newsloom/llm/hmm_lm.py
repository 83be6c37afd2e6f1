"""Hidden Markov language model.

A few latent states emit words and the end of a text. Texts become codes of words, block by block, and every word has
one owner in the cluster that counts it and answers the blocks that hold it; so counts and emissions of all words, as
many as the corpus has, live in tables that are dealt by word and never gathered.

Baum-Welch runs over all training texts, and every word is estimated anew in every round. A block knows its own words'
emissions, runs the recursions over its texts and tells each owner what share of its words' tokens each state has; the
owner adds this up over the blocks and answers with the words' shares among states, drawn towards the states' own where a
word is rare. Only starts, moves, ends and the states' sizes, a few numbers by state, reach the driver.

Scoring is the scaled forward recursion over the whole text, so it is the exact likelihood. A state emits a known word
by its share of the state's tokens, with add-half shares, and one such share stands for the event of any unseen word; so
the model is a distribution over texts in which all unseen words are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.blocks import coded, codes_of, met, numbering, numbers, placed, squeeze, unpack, unsqueeze
from newsloom.llm.common import remove_folder, space_words, staged_at, staged_by
from newsloom.llm.quality_rules import crc_fold

#: Tokens that one recursion holds (a longer text is held alone), and the longest stretch without a cut.
_TOKENS, _STRETCH = 2_000_000, 1024
#: Fractions are sent in steps of this size.
_STEPS = 65_535


@dataclass
class Hmm:
    """start (K), move (K, K), emit (symbols, K): probabilities, rows of ``move`` and columns of ``emit`` sum to one."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def begin(unigram: np.ndarray, states: int, seed: int) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = unigram[:, None] * rng.gamma(0.5, 1.0, (len(unigram), states)).clip(1e-3)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


class Stretches:
    """Stretches of one array side by side, step by step: the columns of step t are those of all that are longer.

    ``at`` has the place in the array of every column, ``alive`` how many columns each step has, ``first`` where a step's
    columns begin; ``order`` sorts the stretches, longest first.
    """

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        long = sizes[self.order]
        self.alive = (len(long) - np.searchsorted(long[::-1], np.arange(long[0]), side="right")).tolist()
        self.first = np.concatenate([[0], np.cumsum(self.alive)]).tolist()
        begin = starts[self.order]
        self.at = np.concatenate([begin[:n] + t for t, n in enumerate(self.alive)])

    def steps(self) -> Iterator[tuple[int, slice]]:
        return ((n, slice(a, a + n)) for n, a in zip(self.alive, self.first))


class Recursion:
    """Scaled forward and backward recursions over sequences that lie behind each other in ``flat``.

    ``emit`` has a row of state probabilities for every symbol. Sequences are cut into stretches that run side by side,
    states by columns. What enters a stretch is exact: the transfer matrices of the stretches behind a first one are
    multiplied out, and messages are carried over the cuts through them.
    """

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, flat: np.ndarray, sizes: np.ndarray, stretch: int = _STRETCH):
        self.move, self.emit, self.k = move, np.ascontiguousarray(emit.T), len(start)
        heads = np.cumsum(sizes) - sizes
        cuts = -(-sizes // stretch)
        self.depth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        self.sequence = np.repeat(np.arange(len(sizes)), cuts)
        self.starts = np.repeat(heads, cuts) + stretch * self.depth
        self.sizes = np.minimum(stretch, np.repeat(heads + sizes, cuts) - self.starts)
        enter = np.empty((self.k, len(self.starts)))  # the message at a stretch's first place, before what it emits
        enter[:, self.depth == 0] = start[:, None]
        self.more = np.flatnonzero(self.depth)
        if len(self.more):
            self.before = self._messages(flat, start)
            enter[:, self.more] = move.T @ self.before
        self.lay = Stretches(self.starts, self.sizes)
        self.here = self._taken(flat[self.lay.at])
        self.forward, self.scales = np.empty_like(self.here), np.empty(self.here.shape[1])
        self._run(self.lay, self.here, enter[:, self.lay.order], self.forward, self.scales)

    def _taken(self, symbols: np.ndarray) -> np.ndarray:
        return np.take(self.emit, symbols, axis=1)

    def _run(self, lay: Stretches, here: np.ndarray, enter: np.ndarray, forward: np.ndarray, scales: np.ndarray) -> None:
        a, by = enter, np.ascontiguousarray(self.move.T)
        for t, (n, cols) in enumerate(lay.steps()):
            a = (by @ a[:, :n] if t else a) * here[:, cols]
            scale = a.sum(0)
            a /= scale
            forward[:, cols], scales[cols] = a, scale

    def _levels(self) -> Iterator[tuple[int, np.ndarray]]:
        """Places in ``more`` by depth; the stretch before one of depth two or more is at the place before."""
        depth = self.depth[self.more]
        order = np.argsort(depth, kind="stable")
        found = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        return [(int(depth[places_[0]]), places_) for places_ in found]

    def _messages(self, flat: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The message at the end of what lies before each stretch of ``more``."""
        k, firsts = self.k, self.more[self.depth[self.more] == 1] - 1
        lay = Stretches(self.starts[firsts], self.sizes[firsts])
        here = self._taken(flat[lay.at])
        ends = np.empty_like(here)
        self._run(lay, here, np.repeat(start[:, None], len(firsts), axis=1), ends, np.empty(here.shape[1]))
        # all firsts of long sequences are as long as a stretch, so the last step has all of them
        last = np.empty((k, len(firsts)))
        last[:, lay.order] = ends[:, lay.first[-2] :]
        self.through = self._transfers(flat)
        out = np.empty((k, len(self.more)))
        for depth, w in self._levels():
            if depth == 1:
                out[:, w] = last
            else:
                carried = np.einsum("in,ijn->jn", out[:, w - 1], self.through[:, :, w - 1])
                out[:, w] = carried / carried.sum(0)
        return out

    def _transfers(self, flat: np.ndarray) -> np.ndarray:
        """For each stretch of ``more`` the matrix that takes the message before it to its end, up to scale."""
        k, lay = self.k, Stretches(self.starts[self.more], self.sizes[self.more])
        here, by = self._taken(flat[lay.at]), np.ascontiguousarray(self.move.T)
        x = np.empty((k, k, len(self.more)))  # from, to, stretch
        for t, (n, cols) in enumerate(lay.steps()):
            for i in range(k):
                x[i, :, :n] = (by @ x[i, :, :n] if t else self.move[i][:, None]) * here[:, cols]
            if t % 16 == 15:
                x[:, :, :n] /= x[:, :, :n].sum((0, 1))
        out = np.empty_like(x)
        out[:, :, lay.order] = x / x.sum((0, 1))
        return out

    def log_likelihoods(self) -> np.ndarray:
        """The natural log-likelihood of every sequence."""
        of = np.concatenate([self.sequence[self.lay.order[:n]] for n in self.lay.alive])
        return np.bincount(of, np.log(self.scales))

    def smooth(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, expected moves, and the states' probabilities at the places ``lay.at``, by column.

        The forward messages are used up.
        """
        leave = np.ones((self.k, len(self.starts)))
        if len(self.more):
            for depth, w in reversed(self._levels()):
                found = np.einsum("ijn,jn->in", self.through[:, :, w], leave[:, self.more[w]])
                leave[:, self.more[w] - 1] = found / (found * self.before[:, w]).sum(0)
        lay, moves = self.lay, np.zeros((self.k, self.k))
        leave = leave[:, lay.order]
        b = leave.copy()
        right = np.empty_like(b)
        for t in range(len(lay.alive) - 1, -1, -1):
            # stretches that end at this step have what leaves them, others what came back
            n, a = lay.alive[t], lay.first[t]
            gone, cols = b[:, :n], slice(a, a + n)
            np.multiply(self.here[:, cols], gone, out=right[:, :n])
            right[:, :n] /= self.scales[cols]
            self.forward[:, cols] *= gone
            if t:
                before = lay.first[t - 1]
                moves += self.forward[:, before : before + n] @ right[:, :n].T
                b[:, :n] = self.move @ right[:, :n]
        back = np.empty_like(right)
        back[:, lay.order] = right
        if len(self.more):
            moves += self.before @ back[:, self.more].T
        gamma = self.forward
        heads = self.depth[lay.order] == 0
        return gamma[:, : lay.alive[0]][:, heads].sum(1), moves * self.move, gamma


def _joined(model: Hmm, sequences: list[np.ndarray], stretch: int) -> tuple[np.ndarray, Recursion]:
    flat = np.concatenate(sequences)
    return flat, Recursion(model.start, model.move, model.emit, flat, np.array(list(map(len, sequences))), stretch)


def log_likelihoods(model: Hmm, sequences: list[np.ndarray], stretch: int = _STRETCH) -> np.ndarray:
    """Natural log-likelihood of each sequence by the scaled forward recursion."""
    return _joined(model, sequences, stretch)[1].log_likelihoods()


def expected_counts(model: Hmm, sequences: list[np.ndarray], stretch: int = _STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of start, moves and emissions over the sequences, and their log-likelihood."""
    flat, run = _joined(model, sequences, stretch)
    total = float(np.log(run.scales).sum())
    start, moves, gamma = run.smooth()
    return start, moves, np.stack([np.bincount(flat[run.lay.at], g, len(model.emit)) for g in gamma], axis=1), total


def updated(model: Hmm, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray, weight: float = 1.0) -> Hmm:
    """The next model: counts plus small prior counts, so that nothing of the alphabet becomes impossible."""
    start, move = start + 0.1, move + 0.1
    emit = emit + weight * unigram[:, None]
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


# --- the cluster's side --------------------------------------------------------------------------------------------


@dataclass
class States:
    """What all tasks know: by state its start, moves, chance to end, and tokens of words; ``total`` and ``distinct`` of training.

    ``total`` tokens and ``distinct`` types include the ends, ``ends`` are the training texts.
    """

    start: np.ndarray
    move: np.ndarray
    end: np.ndarray
    tokens: np.ndarray
    total: int
    distinct: int
    ends: int

    def prior(self) -> np.ndarray:
        """The states' shares of all words' tokens."""
        some = self.tokens + 1e-6 * self.tokens.sum() + 1e-12
        return some / some.sum()

    def emission(self, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """By word and state: a known word's tokens in the state and half a token; of an unknown one the half alone."""
        half = 0.5 * self.prior()
        types = self.distinct - (self.ends > 0)
        return (1 - self.end) * (counts[:, None] * shares + half) / (self.tokens + (types + 1) * half)


def steps(parts: np.ndarray) -> np.ndarray:
    """Rows of fractions that sum to one, without the last, in steps that never add up to more than all."""
    return np.floor(parts[:, :-1] * _STEPS).astype("<u2")


def fractions(found: np.ndarray, k: int) -> np.ndarray:
    some = found.reshape(-1, k - 1).astype(np.float64) / _STEPS
    return np.concatenate([some, 1 - some.sum(1, keepdims=True)], axis=1)


def first_shares(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Where rounds begin: uneven shares among states that a word's hash alone decides."""
    h = hashes[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)
    some = np.log(1 / (u + 1e-12)) ** 2 + 1e-3
    return some / some.sum(1, keepdims=True)


_ANSWER = "block int, owner int, counts binary, parts binary, sums array<double>"
_ANSWER_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64())]


def _answers(rows: list[tuple]) -> pa.Table:
    names = ("block", "owner", "counts", "parts", "sums")
    return pa.table({name: pa.array(c, t) for name, t, c in zip(names, _ANSWER_TYPES, zip(*rows))})


def count_words(messages: DataFrame, k: int, seed: int, owners: int) -> DataFrame:
    """Owners count their words over all blocks; staged by owner.

    Rows ``(owner, block, ids, learnt)`` stay with the owner: its numbers of a block's words and their training tokens
    there. Rows with ``parts`` are the first answers, see ``_ANSWER``: counts (64-bit) and shares of a block's words. A
    row without a block has ``sums``: the owner's training tokens by state, and its distinct training words.
    """

    def run(asked: pa.Table) -> pa.Table:
        owner, index = asked["owner"][0].as_py(), numbering()
        wanted = [numbers(index, unpack(m)) for m in asked["words"].to_pylist()]
        words, sums = list(index), np.zeros(len(index), np.int64)
        for want, learnt in zip(wanted, asked["learnt"].to_pylist()):
            sums[want] += np.frombuffer(unsqueeze(learnt), "<u4")  # the words of a message are distinct
        kept = steps(first_shares(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), k, seed))
        by_state = (sums[:, None] * fractions(kept, k)).sum(0)
        rows = [(b, owner, squeeze(sums[w].astype("<i8").tobytes()), squeeze(kept[w].tobytes()), None) for b, w in zip(asked["block"].to_pylist(), wanted)]
        out = _answers([*rows, (None, owner, None, None, [*by_state, float((sums > 0).sum())])])
        stay = [squeeze(w.astype("<u4").tobytes()) for w in wanted]
        return out.append_column("ids", pa.array([*stay, None], pa.binary())).append_column("learnt", pa.array([*asked["learnt"].to_pylist(), None], pa.binary()))

    told = messages.groupBy("owner").applyInArrow(run, f"{_ANSWER}, ids binary, learnt binary")
    return staged_by(told, "word-owners", "owner", owners)


class Block:
    """A block's texts, and its words with the emissions that answers give them."""

    def __init__(self, table: pa.Table, answers: pa.Table, states: States):
        rows, said = table.to_pylist(), {r["owner"]: r for r in answers.to_pylist()}
        # an owner's words of the block by their codes here
        self.parts = [(r["owner"], placed(r["places"])) for r in rows if r["owner"] is not None]
        self.texts = [r["codes"] for r in rows if r["owner"] is None]
        size, k = sum(len(at) for _, at in self.parts), len(states.start)
        self.counts, shares = np.zeros(size, np.int64), np.zeros((size, k))
        for owner, at in self.parts:
            self.counts[at] = np.frombuffer(unsqueeze(said[owner]["counts"]), "<i8")
            shares[at] = fractions(np.frombuffer(unsqueeze(said[owner]["parts"]), "<u2"), k)
        self.end = size
        self.emit = np.concatenate([states.emission(self.counts, shares), states.end[None]])

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts up to ``_TOKENS`` tokens: codes with ends, sizes."""
        held, n, end = [], 0, np.array([self.end], "<u4")
        for i, raw in enumerate(self.texts):
            held += [codes_of(raw), end]
            n += len(held[-2]) + 1
            if n >= _TOKENS or i + 1 == len(self.texts):
                yield np.concatenate(held), np.array([len(c) + 1 for c in held[::2]])
                held, n = [], 0


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_fold: int = 1, states: int = 4, rounds: int = 5, seed: int = 7, shrink: float = 4.0,
    block_words: int = 400_000, block_tokens: int = 4_000_000,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Learns from rows whose crc fold is not ``held_fold`` (a null id has no fold and is learnt from). A null text counts
    as empty: one token, its end. ``score`` is the log10 likelihood of the whole text, ``base_score`` that of smoothed
    word counts. Baum-Welch reads every training text whole: a start is counted once a text, and every move inside it.
    A word of ``n`` training tokens keeps ``n / (n + shrink)`` of what its own tokens say about its states. Repeated
    rows are scored each; an empty table gives an empty result; with no training rows every word is unknown. Other
    columns are not read. ``block_words`` and ``block_tokens`` bound what a task holds, not what is done.
    """
    if states < 2:
        raise ValueError("a model of less than two states has nothing latent")
    held_out = F.coalesce(crc_fold(F.col(id_col)) == held_fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), (~held_out).alias("learn"), F.col(text_col).alias("text"))
    texts = coded(rows, space_words, "words", learn="learn", block_words=block_words, block_tokens=block_tokens)
    n, ends = texts.rows.where("learn").agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    owners = count_words(texts.messages, states, seed, min(4 * texts.buckets, 100_000))
    begun = _summed(owners, states + 1)
    model = _begin(states, seed, begun[:-1], n + ends, round(begun[-1]) + (ends > 0), ends)
    learn = texts.table.where("owner is not null or learn").select("block", "owner", "places", "codes")
    answers, path = owners.where("parts is not null").select("block", "owner", "counts", "parts", "sums"), None
    for _ in range(rounds if ends else 0):
        answers, model, written = baum_welch(learn, owners, answers, model, shrink)
        if path:  # the round has read what the one before wrote
            remove_folder(docs.sparkSession, path)
        path = written
    return _scored(texts.table.select("block", "owner", "places", "id", "held_out", "codes", "size"), answers, model).withColumnRenamed("id", id_col)


def _begin(k: int, seed: int, tokens: np.ndarray, total: int, distinct: int, ends: int) -> States:
    move = np.full((k, k), 0.1 / (k - 1))
    np.fill_diagonal(move, 0.9)
    # ends are as uneven among states as words are
    share = first_shares(np.array([0], np.uint64), k, seed)[0]
    return States(np.full(k, 1 / k), move, (ends * share + ends / max(1, total)) / (ends * share + tokens + 1), tokens, total, distinct, ends)


def _summed(answers: DataFrame, size: int) -> np.ndarray:
    """The sums of the rows without a block, place by place: a few numbers by state."""
    out = np.zeros(size)
    for row in answers.where("block is null").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[row["at"]] = row["v"]
    return out


def baum_welch(learn: DataFrame, owners: DataFrame, answers: DataFrame, model: States, shrink: float) -> tuple[DataFrame, States, str]:
    """One round: new answers for every word, the new states, and where the answers were written.

    Blocks tell owners the states' shares of each of their words' training tokens; what they say of starts, moves and
    ends travels with it, to the first owner.
    """
    sent = learn.sparkSession.sparkContext.broadcast(model)
    k = len(model.start)
    size = 2 * k + k * k

    def count(table: pa.Table, said: pa.Table) -> pa.Table:
        block = Block(table, said, sent.value)
        sums, totals = np.zeros((block.end + 1, k)), np.zeros(size)
        for flat, sizes in block.groups():
            run = Recursion(sent.value.start, sent.value.move, block.emit, flat, sizes)
            start, moves, gamma = run.smooth()
            sums += np.stack([np.bincount(flat[run.lay.at], g, len(sums)) for g in gamma], axis=1)
            totals[:-k] += np.concatenate([start, moves.reshape(-1)])
        totals[-k:] = sums[-1]
        n = np.rint(sums[:-1].sum(1))
        parts = steps(sums[:-1] / np.maximum(n, 1)[:, None])
        number = table["block"][0].as_py() if table.num_rows else None
        rows = [(number, owner, None, squeeze(parts[at].tobytes()), None) for owner, at in block.parts if n[at].any()]
        first = block.parts[0][0] if block.parts else 0
        return _answers([*rows, (None, first, None, None, totals.tolist())] if block.texts else rows or [(None, 0, None, None, [0.0] * size)])

    def owned(told: pa.Table, mine: pa.Table) -> pa.Table:
        now, out, totals = sent.value, [], np.zeros(size)
        said = {}
        for r in told.to_pylist():
            if r["block"] is None:
                totals += r["sums"]
            else:
                said[r["block"]] = r["parts"]
        stay = [(r["block"], np.frombuffer(unsqueeze(r["ids"]), "<u4"), np.frombuffer(unsqueeze(r["learnt"]), "<u4")) for r in mine.to_pylist() if r["block"] is not None]
        tokens = np.zeros(k)
        if stay:
            top = max(int(ids.max()) for _, ids, _ in stay) + 1
            n, sums = np.zeros(top, np.int64), np.zeros((top, k))
            for number, ids, learnt in stay:
                n[ids] += learnt
                if number in said:
                    sums[ids] += learnt[:, None] * fractions(np.frombuffer(unsqueeze(said[number]), "<u2"), k)
            kept = steps((sums + shrink * now.prior()) / (n + shrink)[:, None])
            tokens = (n[:, None] * fractions(kept, k)).sum(0)
            owner = mine["owner"][0].as_py()
            out = [(number, owner, squeeze(n[ids].astype("<i8").tobytes()), squeeze(kept[ids].tobytes()), None) for number, ids, _ in stay]
        return _answers([*out, (None, None, None, None, [*totals, *tokens])])

    told = met(learn, answers, count, _ANSWER)
    stay = owners.select("owner", "block", "ids", "learnt")
    new, path = staged_at(told.groupBy("owner").cogroup(stay.groupBy("owner")).applyInArrow(owned, _ANSWER), "word-answers")
    found = _summed(new, size + k)
    start, move, ends, tokens = np.split(found, [k, k + k * k, size])
    start, move = start + 0.1, move.reshape(k, k) + 0.1
    end = (ends + model.ends / max(1, model.total)) / (ends + tokens + 1)
    sent.destroy()
    return new.where("block is not null"), States(start / start.sum(), move / move.sum(1, keepdims=True), end, tokens, model.total, model.distinct, model.ends), path


def _scored(table: DataFrame, answers: DataFrame, model: States) -> DataFrame:
    """Every text's base score and exact log10 likelihood, in its block."""
    divisor = model.total + 0.5 * (model.distinct + 1)
    sent = table.sparkSession.sparkContext.broadcast(model)

    def score(table: pa.Table, said: pa.Table) -> pa.Table:
        now = sent.value
        block, rows = Block(table, said, now), table.filter(pc.is_null(table["owner"]))
        base = np.log10((np.append(block.counts, now.ends) + 0.5) / divisor)
        is_known = np.append(block.counts > 0, now.ends > 0)
        scores, bases, knowns = [], [], []
        for flat, sizes in block.groups():
            heads = np.cumsum(sizes) - sizes
            scores.append(Recursion(now.start, now.move, block.emit, flat, sizes).log_likelihoods() / math.log(10))
            bases.append(np.add.reduceat(base[flat], heads))
            knowns.append(np.add.reduceat(is_known[flat].astype(np.int64), heads))
        joined = lambda parts, t: pa.array(np.concatenate(parts), t) if parts else pa.array([], t)
        return pa.table({
            "id": rows["id"], "held_out": rows["held_out"], "n_tokens": pc.add(rows["size"], 1), "n_known": joined(knowns, pa.int64()),
            "train_tokens": pa.array([now.total] * rows.num_rows, pa.int64()), "base_score": joined(bases, pa.float64()), "score": joined(scores, pa.float64()),
        })

    kind = table.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met(table, answers, score, schema)
