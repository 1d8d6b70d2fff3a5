"""Punctuation carry over a word stream (W15, ST5) -- batch twin and streaming.

Words arrive with punctuation ids (2 = comma, 3/4 = sentence end) in mini-batches of
``chunk`` words, each prefixed with the words carried from before.  When a further
mini-batch follows, the words up to the last sentence end are emitted and the rest is
carried; the first two and the last word of a mini-batch are not looked at, for their marks
may still change.  A carry of more than ``max_carry`` words without a sentence end is cut
after its last comma, which becomes a sentence end; without a comma all of it is carried on.
The last mini-batch is emitted whole, without its final mark (the next text decides that).
Words that meet with single-byte characters are parted by a space, also across emissions.
The same ``PunctCarry`` fold runs over buckets of a session, chained by their states, and in
``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Iterator
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUT = T.StructType([T.StructField("session", T.LongType()), T.StructField("seq", T.LongType()),
                    T.StructField("n_words", T.LongType()), T.StructField("text", T.StringType())])
STATE = T.StructType([T.StructField("words", T.ArrayType(T.StringType())),
                      T.StructField("puncs", T.ArrayType(T.IntegerType())),
                      T.StructField("pending", T.LongType()), T.StructField("seq", T.LongType()),
                      T.StructField("before", T.StringType())])
# The marks written after a word by punctuation id (2, 3, 4, 5).
MARKS = {2: "，", 3: "。", 4: "？", 5: "、"}


SENTENCE_ENDS = (3, 4)
COMMA, PERIOD = 2, 3


class PunctCarry:
    def __init__(self, chunk: int = 20, max_carry: int = 200, state: tuple | None = None):
        self.chunk, self.max_carry = chunk, max_carry
        words, puncs, self.pending, self.seq, self.before = state or ([], [], 0, 0, "")
        self.words, self.puncs = list(words), list(puncs)

    def state(self) -> tuple:
        return (self.words, self.puncs, self.pending, self.seq, self.before)

    def _emit(self, k: int, out: list, last: bool = False) -> None:
        """Write out the first k words; ``before`` is the last character written by an earlier word."""
        if k <= 0:
            return
        text = []
        for w, p in zip(self.words[:k], self.puncs[:k], strict=True):
            apart = w[:1].isascii() and w and self.before.isascii() and self.before
            text.append((" " if apart else "") + w + MARKS.get(p, ""))
            self.before = w[-1:]
        if last and self.puncs[k - 1] in MARKS:
            text[-1] = text[-1][:-1]
        out.append((self.seq, k, "".join(text)))
        self.seq += 1
        self.words, self.puncs = self.words[k:], self.puncs[k:]

    def _cut(self, out: list) -> None:
        settled = range(2, len(self.words) - 1)
        at = max((i for i in settled if self.puncs[i] in SENTENCE_ENDS), default=-1)
        if at < 0 and len(self.words) > self.max_carry:
            at = max((i for i in settled if self.puncs[i] == COMMA), default=-1)
            if at >= 0:
                self.puncs[at] = PERIOD
        self._emit(at + 1, out)
        self.pending = 0

    def push(self, words, puncs) -> list:
        out: list = []
        for w, p in zip(words, puncs, strict=True):
            if self.pending == self.chunk:  # a full mini-batch, and another one begins
                self._cut(out)
            self.words.append(str(w))
            self.puncs.append(int(p))
            self.pending += 1
        return out

    def finish(self) -> list:
        out: list = []
        self._emit(len(self.words), out, last=True)
        return out


def _rows(session, items):
    return [(int(session), int(s), int(n), t) for s, n, t in items]


class CarryChain:
    """The carry as a map from entry to exit state, for ``chained_fold``; emissions are numbered outside."""

    fields = "pos long, n_words long, text string"

    def __init__(self, chunk: int, max_carry: int) -> None:
        self.chunk, self.max_carry = chunk, max_carry

    def guess(self, offset: int) -> tuple:
        """As if the mini-batches before had been emitted whole; a full one is cut by the word after it."""
        return ([], [], offset and (offset - 1) % self.chunk + 1, 0, "")

    def run(self, state: tuple, batches: Iterator[pd.DataFrame], last: bool) -> tuple[tuple, list, int]:
        fold, out = PunctCarry(self.chunk, self.max_carry, tuple(state)), []
        for b in batches:
            out += fold.push(b["w"], b["p"])
        if last:
            out += fold.finish()
        words, puncs, pending, _, before = fold.state()
        return (words, puncs, pending, 0, before), out, len(out)


def carry_batch(words: DataFrame, session: str, order: list[str], word: str, punc: str,
                chunk: int = 20, max_carry: int = 200, rows_per_bucket: int | None = None) -> DataFrame:
    """The carry over whole sessions; a long one is cut into buckets that run at once (see ``chained_fold``)."""
    from corpusvox.plans.chained import chained_fold

    rows = words.select(F.col(session).cast("long").alias("session"), *order, F.col(word).alias("w"),
                        F.col(punc).cast("int").alias("p"))
    out = chained_fold(rows, "session", order, ["w", "p"], CarryChain(chunk, max_carry), rows_per_bucket)
    return out.select("session", (F.col("_before") + F.col("pos")).alias("seq"), "n_words", "text")


def carry_stream(words: DataFrame, session: str, order: list[str], word: str, punc: str, final: str,
                 chunk: int = 20, max_carry: int = 200) -> DataFrame:
    from pyspark.sql.streaming.state import GroupStateTimeout
    prepared = words.select(F.col(session).cast("long").alias("session"), *order, F.col(word).alias("w"),
                            F.col(punc).cast("int").alias("p"), F.col(final).cast("boolean").alias("final"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        f = PunctCarry(chunk, max_carry, tuple(state.get) if state.exists else None)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        fin = pdf["final"].to_numpy()
        stop = int(fin.argmax()) + 1 if fin.any() else len(pdf)
        r = f.push(pdf["w"].to_numpy()[:stop], pdf["p"].to_numpy()[:stop])
        if fin.any():
            r += f.finish()
            state.remove()
        else:
            state.update(f.state())
        if r:
            yield pd.DataFrame(_rows(key[0], r), columns=OUT.fieldNames())

    return prepared.groupBy("session").applyInPandasWithState(step, OUT, STATE, "append",
                                                               GroupStateTimeout.NoTimeout)
