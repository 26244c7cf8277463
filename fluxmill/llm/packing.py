"""Vector bin packing: a dot-product heuristic under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .texts import LOWER_ASCII, bounded_batches, pieces


@dataclass(frozen=True)
class Limits:
    """Of a sequence. ``pool``: examples that wait in a task's memory at once."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    pool: int = 512


class Packer:
    """Fills sequences one after another from a pool of waiting examples.

    The oldest example opens a sequence; then the example that fits and has the
    largest dot product with the room left, each in units of its limit, is
    placed again and again. If none fits and examples may be cut, the largest
    one is cut to fill the room. Memory is bounded by the pool.
    """

    def __init__(self, limits: Limits, cut: bool):
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.limits, self.cut = limits, cut
        self.keys: list = []
        self.sizes = np.empty((0, 3))
        self.starts: list[int] = []
        self.sequence = 0
        self.waiting: list[tuple] = []

    def add(self, key, tokens: int, loss: int, start: int = 0) -> Iterator[tuple]:
        """Takes an example; yields the placed pieces (key, start, length, sequence, offset)."""
        full = self.limits.tokens
        if self.cut:
            while tokens >= full and loss == tokens and full <= self.limits.loss:
                yield key, start, full, self.sequence, 0
                self.sequence += 1
                start, tokens, loss = start + full, tokens - full, loss - full
            if not tokens:
                return
        elif tokens > full or loss > self.limits.loss:
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, exceeds a sequence")
        self.waiting.append((key, tokens, loss, start))
        if len(self.waiting) + len(self.keys) >= self.limits.pool:
            self._take()
            while len(self.keys) > self.limits.pool // 2:
                yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        self._take()
        while self.keys:
            yield from self._fill()

    def _take(self) -> None:
        if self.waiting:
            self.keys += [w[0] for w in self.waiting]
            self.starts += [w[3] for w in self.waiting]
            self.sizes = np.concatenate([self.sizes, np.array([[w[1], 1, w[2]] for w in self.waiting], float)])
            self.waiting = []

    def _fill(self) -> Iterator[tuple]:
        room, offset, gone = self.caps.copy(), 0, []
        live = np.ones(len(self.keys), bool)
        share = self.sizes / self.caps
        pick = 0
        while pick is not None:
            n = int(self.sizes[pick, 0])
            yield self.keys[pick], self.starts[pick], n, self.sequence, offset
            offset += n
            room -= self.sizes[pick]
            live[pick] = False
            gone.append(pick)
            fits = live & (self.sizes <= room).all(axis=1)
            if fits.any():
                pick = int(np.where(fits, share @ (room / self.caps), -1.0).argmax())
            else:
                pick = None
        if self.cut and room[0] >= 1 and room[1] >= 1 and live.any():
            big = int(np.where(live & (self.sizes[:, 0] == self.sizes[:, 2]), self.sizes[:, 0], -1).argmax())
            n = int(min(room[0], room[2]))
            if live[big] and self.sizes[big, 0] > n >= 1:
                yield self.keys[big], self.starts[big], n, self.sequence, offset
                self.starts[big] += n
                self.sizes[big, [0, 2]] -= n
        self.sequence += 1
        self.keys = [k for k, x in zip(self.keys, live, strict=True) if x]
        self.starts = [k for k, x in zip(self.starts, live, strict=True) if x]
        self.sizes = self.sizes[live]


#: Words of one call to the tokenizer, and the mark that stands between them there.
TOGETHER, MARK = 500, "\x02"
_PROBE = "It's  3 o'clock, naïve Ünits of x-y (z) a\x0bb\x0cc\td\re\nf {}".format("supercalifragilistic")


_MARK = MARK.encode()


class _Words(dict):
    """Ids of words. One that is met for the first time is there, and in ``fresh``, with an empty array that is filled before its next use."""

    def __init__(self):
        super().__init__()
        self.fresh: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        self[word] = self.fresh[word] = found = bytearray()
        return found


class Encoder:
    """Little-endian 32-bit ids of texts; those of the words seen first are remembered.

    For a tokenizer that drops white space, a text's ids are those of its parts
    between ASCII white space, as its pieces, and what normalization changes,
    never reach across it; a probe of the tokenizer tells. Other tokenizers
    encode whole texts. Words that are not remembered go to the tokenizer many at
    a time, with a mark of one id between them. If normalization lower-cases
    A-Z, so do words, and marks that always are pieces of their own part from
    the end of words that aren't known.
    """

    LIMIT, LONGEST = 500_000, 64

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, _Words()
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.by_word = np.array_equal(self._ids(_PROBE), np.concatenate([self._ids(w) for w in _PROBE.split()]))
        self.table = LOWER_ASCII if self._lowers() else bytes(range(256))
        self.tails = tuple(t for t in (b".", b",") if self._parts(t.decode()))

    def _lowers(self) -> bool:
        """Whether normalization lower-cases A-Z, wherever they stand."""
        upper = string.ascii_uppercase
        normal = self.tokenizer.normalizer
        return normal is not None and all(normal.normalize_str(f"{x}{c}{x}") == normal.normalize_str(f"{x}{c.lower()}{x}") for c in upper for x in ("", "a", "-"))

    def _parts(self, tail: str) -> bool:
        """Whether a last ``tail`` is always a piece of its own after an ASCII letter or digit; ids never reach across pieces."""
        before = self.tokenizer.pre_tokenizer
        if before is None:
            return False
        return all((found := before.pre_tokenize_str(f"a{c}{tail}"))[-1][0] == tail and len(found) > 1 for c in string.ascii_letters + string.digits)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        plain = [w for w in words if _MARK not in w and len(w) <= self.LONGEST] if self.mark is not None else []
        for w in set(words).difference(plain) if len(plain) < len(words) else ():
            yield w, self._ids(w.decode()).tobytes()
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([b" \x02 ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(group) - 1:
                yield from ((w, self._ids(w.decode()).tobytes()) for w in group)
                continue
            raw, begin = ids.tobytes(), 0
            for w, end in zip(group, [*(4 * ends).tolist(), len(raw)], strict=True):
                yield w, raw[begin:end]
                begin = end + 4

    def _learn(self) -> None:
        """Fills in the words met for the first time; a word with a last mark that is always a piece of its own is that of its stem."""
        known, with_tail = self.known, []
        for w in list(known.fresh):
            if w[-1:] in self.tails and w[-2:-1].isalnum():
                with_tail.append(w)
                known[w[:-1]], known[w[-1:]]  # noqa: B018  # met, too
        tailed = set(with_tail)
        for w, ids in self._encoded([w for w in known.fresh if w not in tailed]):
            known.fresh[w] += ids
        for w in with_tail:
            known.fresh[w] += bytes(known[w[:-1]]) + bytes(known[w[-1:]])

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        known = self.known
        get = known.__getitem__
        before = len(known)
        rows = [list(map(get, t.encode().translate(self.table).split())) for t in texts]
        self._learn()
        out = [b"".join(r) for r in rows]
        room = self.LIMIT - before
        for k, (w, ids) in enumerate(known.fresh.items()):
            if k < room and len(w) <= self.LONGEST:
                known[w] = bytes(ids)
            else:
                del known[w]
        known.fresh = {}
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's tasks share the words it remembers."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one core
    return Encoder(Tokenizer.from_file(path))


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _packed(path: str, end_id: int, limits: Limits, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    schema = _PIECES if with_ids else pa.schema(list(_PIECES)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        base = TaskContext.get().partitionId() << 40
        packer = Packer(limits, cut=True)
        rows: list[tuple] = []

        def keep(pieces):
            for (doc_id, ids), start, n, sequence, offset in pieces:
                part = ids[4 * start : 4 * (start + n)]
                rows.append((doc_id, start, n, zlib.crc32(part), len(ids) // 4, base + sequence, offset, part))

        def out():
            columns = list(zip(*rows, strict=True))[: len(schema)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for part in chain.from_iterable(map(pieces, batches)):
            texts = [t or "" for t in part.column("text").to_pylist()]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                keep(packer.add((doc_id, ids), n, n))
                if len(rows) >= 500:
                    yield out()
                    rows.clear()
        keep(packer.finish())
        if rows:
            yield out()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """Pieces of tokenized documents, packed into sequences of at most ``limits.tokens`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids as little-endian 32-bit numbers, if asked for).
    Every id of ``docs(doc_id, text)``, the end id included, bears loss and lies
    in one piece. Each task tokenizes and packs what it reads; nothing is
    shuffled, and one sequence a task may end short. sequence_id is unique, by
    the task's number. Null and empty texts are their end id; rows that repeat a
    doc_id are separate documents; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.mapInArrow(_packed(tokenizer_path, end_id, limits, with_ids), schema)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(example_id, sequence_id, offset): whole instruction examples, packed under all three limits.

    ``examples(example_id, tokens, loss_tokens)``; null counts are 0, and an
    example over a limit fails the job rather than being dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer = Packer(limits, cut=False)

        def out(pieces):
            rows = list(pieces)
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([base + r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], names=["example_id", "sequence_id", "offset"])

        for batch in batches:
            yield out(p for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in packer.add(*row))
        yield out(packer.finish())

    columns = [F.col("example_id").cast("long"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long"), F.coalesce(F.col("loss_tokens"), F.lit(0)).cast("long")]
    return examples.select(*columns).mapInArrow(run, "example_id long, sequence_id long, offset long")


def _counted(path: str):
    """Rows with the number of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for part in chain.from_iterable(map(pieces, batches)):
            n = [len(found) // 4 for found in encode([t or "" for t in part.column("text").to_pylist()])]
            yield pa.record_batch([part.column("conv_id"), part.column("turn"), part.column("bears"), pa.array(n, pa.int64())], names=["conv_id", "turn", "bears", "n"])

    return run


def exchanges(turns: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of ``turns(turn, n, loss)`` that end with the last loss-bearing one in a row: answers with all that they answer."""
    held: list[tuple] = []
    for t in turns:
        if held and held[-1][2] and not t[2]:
            yield held
            held = []
        held.append(t)
    if held:
        yield held


def within_limits(turns: list[tuple], limits: Limits) -> Iterator[list[tuple]]:
    """A conversation's ``turns(turn, n, loss)`` in examples (turn, start, n, loss) that fit: whole if it does, else cut between exchanges, and only an exchange over a limit between or within turns."""
    total = lambda part: (sum(t[1] for t in part), sum(t[2] for t in part))
    fits = lambda part: total(part)[0] <= limits.tokens and total(part)[1] <= limits.loss
    if fits(turns):
        yield [(t, 0, n, loss) for t, n, loss in turns]
        return
    held: list[tuple] = []
    for unit in exchanges(turns):
        if fits(held + unit):
            held += unit
            continue
        if held:
            yield [(t, 0, n, loss) for t, n, loss in held]
            held = []
        if fits(unit):
            held = list(unit)
            continue
        room, loss_room, out = limits.tokens, limits.loss, []
        for t, n, loss in unit:
            start = 0
            while start < n:
                most = min(room, loss_room) if loss else room
                if not most:
                    yield out
                    room, loss_room, out = limits.tokens, limits.loss, []
                    continue
                size = min(most, n - start)
                out.append((t, start, size, size if loss else 0))
                room, loss_room, start = room - size, loss_room - (size if loss else 0), start + size
        if out:
            yield out
    if held:
        yield [(t, 0, n, loss) for t, n, loss in held]


_TURNS = "conv_id long, turn long, start long, length long, loss long, sequence_id long, offset long"


def _examples_packed(limits: Limits, first: int):
    """Sorted rows of conversations to placed turns; ``first`` keeps the sequences of two kinds of tasks apart."""
    names, most = [x.split()[0] for x in _TURNS.split(", ")], 4 * limits.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() << 40) + first
        packer, rows = Packer(limits, cut=False), []

        def keep(placed) -> None:
            for (conv, parts), _, _, sequence, offset in placed:
                for turn, start, n, loss in parts:
                    rows.append((conv, turn, start, n, loss, base + sequence, offset))
                    offset += n

        def take(conv, turns: list[tuple]) -> None:
            for parts in within_limits(turns, limits):
                keep(packer.add((conv, parts), sum(p[2] for p in parts), sum(p[3] for p in parts)))

        def out() -> pa.RecordBatch:
            done = pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 7)], names=names)
            rows.clear()
            return done

        held, conv_id, size = [], None, 0
        for batch in batches:
            for conv, turn, bears, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # a conversation that can't fit is handed on at the ends of its exchanges, so that it needn't be held whole
                if held and (conv != conv_id or conv is None or (size > most and held[-1][2] and not bears) or size > 8 * most):
                    take(conv_id, held)
                    held, size = [], 0
                held.append((turn, n, n if bears else 0))
                conv_id, size = conv, size + n
            yield out()
        if held:
            take(conv_id, held)
        keep(packer.finish())
        yield out()

    return run


def pack_conversations(turns: DataFrame, tokenizer_path: str, limits: Limits = Limits(segments=24, loss=1536), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, start, length, loss, sequence_id, offset): conversations, packed whole under all three limits.

    ``turns(conv_id, turn, role, text)``. The example is the conversation, and
    one segment: its turns lie in order in one sequence, so every answer is
    trained with its prompt. Tokens bear loss in turns of ``loss_roles``. A
    conversation over a limit is cut between exchanges, a run of turns up to its
    answers, and only an exchange over a limit within.

    Texts are encoded where they lie; only counts are dealt out. Conversations
    within the limits are so by their turns' number and size that no key is hot;
    those over them are dealt by ranges of turns, and may be cut there as well.
    Null, empty and wordless texts have no token and no piece; a row without
    conv_id is a conversation of its own; rows that repeat a turn are packed one
    by one, and other columns are not read.
    """
    bounded_batches(turns.sparkSession)
    scratch = Scratch(turns.sparkSession, "conversations")
    bears = F.coalesce(F.col("role").cast("string").isin(*loss_roles), F.lit(False)).alias("bears")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("text").cast("string").alias("text"), bears)
    counted = scratch.save(rows.mapInArrow(_counted(tokenizer_path), "conv_id long, turn long, bears boolean, n long").filter("n > 0"), "counted")
    loss = F.sum(F.when(F.col("bears"), F.col("n")).otherwise(0))
    over = counted.filter("conv_id is not null").groupBy("conv_id").agg(F.sum("n").alias("n"), loss.alias("loss"), F.count("*").alias("c"))
    # a conversation of very many turns without tokens to speak of is dealt like a long one
    over = over.filter((F.col("n") > limits.tokens) | (F.col("loss") > limits.loss) | (F.col("c") > limits.tokens)).select("conv_id", F.lit(True).alias("over"))
    known = counted.join(over, "conv_id", "left").select("conv_id", "turn", "bears", "n", F.coalesce("over", F.lit(False)).alias("over"))
    order = ["conv_id", "turn"]
    short = known.filter("not over").drop("over").repartition(F.coalesce("conv_id", F.xxhash64("turn", "n"))).sortWithinPartitions(*order)
    long_ = known.filter("over").drop("over").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    return short.mapInArrow(_examples_packed(limits, 0), _TURNS).unionAll(long_.mapInArrow(_examples_packed(limits, 1 << 39), _TURNS))
