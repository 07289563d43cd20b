"""Log-probabilities of whole documents under a weighted backoff automaton of word n-grams.

The model is a trigram model with Dirichlet smoothing: p(w | h) = (c(hw) + m * p(w | h')) / (c(h) + m), where h' is h without its
first word, and p(w) = (c(w) + 1) / (N + V + 1). It sums to one over the V known tokens and one unknown token. As an automaton:
every n-gram of one or two words that was seen in training is a state; a seen n-gram hw is an arc from h to the longest suffix of
hw that is a state; a state without an arc for a word has a failure arc, of weight m / (c(h) + m), to the state of h'.

How the corpus meets the model, with nothing held whole anywhere:

1. ``training_sizes`` counts training tokens and their distinct ones.
2. Texts are dealt to blocks of a few MB. A block counts its distinct n-grams, as sorted 64-bit keys, and sends each range of keys
   with its training counts to the range's bucket.
3. A bucket adds the counts of all blocks and answers each block with the totals, in the order in which it asked.
4. A block builds the part of the automaton that its own n-grams reach, and reads its texts from left to right: all lanes of
   the block advance together by one token a step, each carrying its state and adding up the weights of the arcs it takes.

So counts cover every training document, and what is shuffled is the texts once and a few bytes per distinct n-gram of a block.
Blocks and buckets grow with the square root of the corpus, so their cells stay worth a row each.

Tokens are named by 61-bit hashes: with ten million distinct ones the odds that any two share a hash are 1 in 50,000. Pairs and
triples are named by the bits that the corpus needs, 48 at least: a lookup meets a wrong count once in two million times.

A null text is empty: one token, the end. A document without an id is scored and learned from; it isn't held out. Texts above
SEGMENT bytes are cut at white space and carry the two words before the cut, so long texts spread over blocks. Repeated rows are
rows of their own, and all count. Without training documents every probability is 1. Extra columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molweave.llm.words import Words, mix, pieces, text_bytes

# Dirichlet weights: how many tokens the shorter context is worth against a context of one and of two words.
WEIGHTS = (5000.0, 3.0)
SEGMENT = 1 << 20
BLOCK_BYTES = 4 << 20
# Bytes of text that a batch deals out together.
DEAL_BYTES = 16 << 20
BUCKET_KEYS = 1 << 19
# Bytes of corpus per byte squared of a block, once that is above BLOCK_BYTES.
ROOT = 64
LANE = 512
SURE_BITS = 21
SPACES = re.compile(rb"[\x20\x09-\x0D]")
BEGIN, END = (mix(np.array([k], np.uint64))[0] for k in (0xB0E1, 0xE0D2))
SALT = np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the seventh of documents that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def _kept_bytes() -> tuple[np.ndarray, np.ndarray]:
    values = np.arange(256, dtype=np.uint8)
    values[0x41:0x5B] += 0x20
    inside = np.ones(256, bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    return values, inside


LOWER, INSIDE = _kept_bytes()


class Tokens(Words):
    """Runs of bytes other than white space, with A-Z lower-cased: row, first byte, end and hash of each."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        self.rows = len(column)
        inside = INSIDE[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = np.empty(len(self.start), np.uint64)
        self.prefix = {}
        self._hash(LOWER[data])


# ---- packed columns of numbers ------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of their places, compressed: small ones take little."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n), dtype=np.uint64)


def _cells(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, slice) of sorted keys by their upper bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for low, high in zip(starts, np.append(starts[1:], len(keys))):
        yield int(bucket[low]), slice(low, high)


# ---- sizes ------------------------------------------------------------------------------------------------------------


def training_sizes(documents: DataFrame) -> dict[str, int]:
    """n_bytes of all texts; train_tokens (N), train_types (V) and train_docs of those to learn from."""
    bits = max(8, int(np.ceil(np.log2(4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))

    def distinct(batches):
        for piece in pieces(batches, "text", DEAL_BYTES):
            texts = piece.column("text")
            learned = piece.filter(piece.column("train")).column("text")
            tokens = Tokens(learned)
            docs = len(learned)
            keys = np.unique(np.append(tokens.hash, END) if docs else tokens.hash)
            n_bytes = len(text_bytes(texts)[0])
            rows = [(b, s.stop - s.start, pack_sorted(keys[s]), 0, 0, 0) for b, s in _cells(keys, bits)]
            rows.append((0, 0, b"", n_bytes, len(tokens.hash) + docs, docs))
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["bucket", "n", "keys", "n_bytes", "n_tokens", "n_docs"])

    def count(rows: pa.Table) -> pa.Table:
        parts = [unpack_sorted(k, n) for k, n in zip(rows.column("keys").to_pylist(), rows.column("n").to_pylist()) if n]
        types = len(np.unique(np.concatenate(parts))) if parts else 0
        sums = [[sum(rows.column(c).to_pylist())] for c in ("n_bytes", "n_tokens", "n_docs")]
        return pa.table([[types], *sums], names=["n_types", "n_bytes", "n_tokens", "n_docs"])

    rows = documents.select("text", (~held_out()).alias("train"))
    sent = rows.mapInArrow(distinct, "bucket long, n long, keys binary, n_bytes long, n_tokens long, n_docs long")
    met = sent.groupBy("bucket").applyInArrow(count, "n_types long, n_bytes long, n_tokens long, n_docs long")
    names = {"n_bytes": "n_bytes", "n_tokens": "train_tokens", "n_types": "train_types", "n_docs": "train_docs"}
    return met.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in names.items()]).first().asDict()


# ---- texts in blocks ----------------------------------------------------------------------------------------------------


def cut(text: bytes, limit: int) -> Iterator[tuple[bytes, bool, bool, int]]:
    """(part, begins, ends, lead): parts of about ``limit`` bytes cut at white space.

    A part starts with the ``lead`` words before it, two or all there are; it begins if these reach back to the text's beginning.
    """
    at, lead, before = 0, [], 0
    while True:
        found = SPACES.search(text, at + limit)
        part = text[at : found.start() if found else len(text)]
        words = part.split()
        if words or found is None:
            yield b" ".join([*lead, part]), before <= 2, found is None, len(lead)
        if found is None:
            return
        before += len(words)
        lead = (lead + words[-2:])[-2:]
        at = found.start()


PART = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("lead", pa.int32()), ("text", pa.string())]
)


def segments(documents: DataFrame, blocks: int, limit: int = SEGMENT) -> DataFrame:
    """(block, rows): texts, the long ones in parts, dealt to blocks by a hash.

    ``rows`` holds what a batch has for a block, as a compressed Arrow stream of the columns PART.
    """
    names = PART.names

    def parts_of(piece: pa.RecordBatch) -> pa.Table:
        short = np.diff(text_bytes(piece.column("text"))[1]) <= limit
        kept = piece.filter(pa.array(short))
        n = kept.num_rows
        whole = [kept.column(c) for c in names[:3]] + [pa.array([True] * n), pa.array([True] * n), pa.array([0] * n, pa.int32()), kept.column("text")]
        rows = []
        for row in piece.filter(pa.array(~short)).to_pylist():
            for part, begins, ends, lead in cut(row.pop("text").encode(), limit):
                rows.append(row | {"begins": begins, "ends": ends, "lead": lead, "text": part.decode()})
        return pa.concat_tables([pa.table(whole, schema=PART), pa.Table.from_pylist(rows, PART)])

    def run(batches):
        for piece in pieces(batches, "text", DEAL_BYTES):
            parts = parts_of(piece)
            number = np.arange(parts.num_rows, dtype=np.uint64)
            block = (mix(parts.column("uid").to_numpy().astype(np.uint64) * SALT + mix(number)) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            parts, block = parts.take(pa.array(order)).combine_chunks(), block[order]
            starts = np.flatnonzero(np.diff(block, prepend=-1))
            for low, high in zip(starts, np.append(starts[1:], len(block))):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, PART, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(parts.slice(low, high - low))
                packed = pa.array([out.getvalue().to_pybytes()], pa.binary())
                yield pa.record_batch([pa.array([block[low]], pa.int64()), packed], names=["block", "rows"])

    rows = documents.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out().alias("held_out"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, "block long, rows binary")


def read_parts(packed: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(rows.as_buffer()).read_all() for rows in packed.column("rows")])


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of single tokens: the lowest eighth of all numbers."""
    return hashes >> np.uint64(3)


def gram_keys(hashes: np.ndarray, unused_bits: int) -> np.ndarray:
    """Keys of pairs and triples, which take the other seven eighths; their lowest bits are 0."""
    spread = (hashes >> np.uint64(3)) * np.uint64(7) + np.uint64(1 << 61)
    return (spread >> np.uint64(unused_bits)) << np.uint64(unused_bits)


def unused_bits(n_bytes: int) -> int:
    """Bits that pairs and triples can go without: one of 2**SURE_BITS lookups may then meet another's count."""
    return 64 - max(48, SURE_BITS + int(np.ceil(np.log2(n_bytes + 1))))


class Lines:
    """Tokens of the texts of a block in a row, and the keys of the words, pairs and triples that end at each of them."""

    def __init__(self, rows: pa.Table, unused_bits: int = 0):
        begins, ends, held = (rows.column(c).to_numpy() for c in ("begins", "ends", "held_out"))
        lead = rows.column("lead").to_numpy()
        tokens = Tokens(rows.column("text").combine_chunks())
        n = tokens.counts()
        size = n + begins + ends
        self.begin = np.cumsum(size) - size
        self.end = self.begin + size
        self.row = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(int(size.sum())) - self.begin[self.row]
        one = np.empty(len(self.row), np.uint64)
        first = np.cumsum(n) - n
        one[(self.begin + begins - first)[tokens.row] + np.arange(len(tokens.row))] = tokens.hash
        one[self.begin[begins]] = BEGIN
        one[self.end[ends] - 1] = END
        self.counted = self.place >= (begins + lead)[self.row]
        self.is_end = np.zeros(len(one), bool)
        self.is_end[self.end[ends] - 1] = True
        two = np.zeros_like(one)
        two[1:] = mix(one[:-1] * SALT + one[1:] + np.uint64(2))
        three = np.zeros_like(one)
        three[2:] = mix(two[1:-1] * SALT + one[2:] + np.uint64(3))
        self.paired = np.flatnonzero(self.place >= 1)
        self.tripled = np.flatnonzero((self.place >= 2) & self.counted)
        learned = ~held[self.row]
        opens = np.zeros(len(one), bool)
        opens[self.begin[begins & (lead == 0)]] = True
        weight = np.concatenate([(self.counted | opens) & learned, (self.counted & learned)[self.paired], learned[self.tripled]])
        keys = np.concatenate([word_keys(one), gram_keys(two[self.paired], unused_bits), gram_keys(three[self.tripled], unused_bits)])
        self.keys, which = np.unique(keys, return_inverse=True)
        self.train = np.bincount(which, weights=weight, minlength=len(self.keys)).astype(np.int64)
        self.word = which[: len(one)]
        self.pair = np.full(len(one), -1)
        self.pair[self.paired] = which[len(one) : len(one) + len(self.paired)]
        self.triple = np.full(len(one), -1)
        self.triple[self.tripled] = which[len(one) + len(self.paired) :]
        self.rows = len(size)


# ---- the automaton -------------------------------------------------------------------------------------------------------


class Automaton:
    """The part of the model that the n-grams of a block reach. State 0 is the root, with an arc for every token."""

    def __init__(self, lines: Lines, total: np.ndarray, sizes: dict[str, int], weights=WEIGHTS):
        self.labels = len(lines.keys)
        tokens = sizes["train_tokens"] + sizes["train_types"] + 1
        word, pair, triple = lines.word, lines.pair, lines.triple
        # One position for each distinct n-gram that was seen in training.
        at_word = self._distinct(word, np.arange(len(word)), np.ones(len(total), bool))
        at_pair = self._distinct(pair, lines.paired, total > 0)
        at_triple = self._distinct(triple, lines.tripled, total > 0)
        states = np.concatenate([word[at_word[total[word[at_word]] > 0]], pair[at_pair[~lines.is_end[at_pair]]]])
        state = np.zeros(self.labels, np.int64)
        state[states] = np.arange(1, len(states) + 1)
        self.states = len(states) + 1
        p_one = np.zeros(self.labels)
        p_one[word[at_word]] = (total[word[at_word]] + 1) / tokens
        self.root_weight = np.log10(p_one, out=np.zeros(self.labels), where=p_one > 0)
        self.root_next = state
        p_two = self._smoothed(total, pair[at_pair], word[at_pair - 1], p_one[word[at_pair]], weights[0])
        of_pair = np.zeros(self.labels)
        of_pair[pair[at_pair]] = p_two
        p_three = self._smoothed(total, triple[at_triple], pair[at_triple - 1], of_pair[pair[at_triple]], weights[1])
        source = np.concatenate([state[word[at_pair - 1]], state[pair[at_triple - 1]]])
        label = np.concatenate([word[at_pair], word[at_triple]])
        arcs = source * self.labels + label
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.arc_weight = np.log10(np.concatenate([p_two, p_three]))[order]
        self.arc_next = np.concatenate([state[pair[at_pair]], state[pair[at_triple]]])[order]
        self.fail_next = np.zeros(self.states, np.int64)
        self.fail_weight = np.zeros(self.states)
        contexts = at_pair[state[pair[at_pair]] > 0]
        self.fail_next[state[pair[contexts]]] = state[word[contexts]]
        heads = word[at_word[state[word[at_word]] > 0]]
        self.fail_weight[state[heads]] = np.log10(weights[0] / (total[heads] + weights[0]))
        self.fail_weight[state[pair[contexts]]] = np.log10(weights[1] / (total[pair[contexts]] + weights[1]))

    @staticmethod
    def _distinct(which: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        some = np.full(len(wanted), -1)
        some[which[at]] = at
        return some[(some >= 0) & wanted]

    @staticmethod
    def _smoothed(total, gram, context, shorter, m):
        return (total[gram] + m * shorter) / (total[context] + m)

    def follow(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after reading a label, weight of the arcs taken): failure arcs until there is one for the label."""
        weight, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            s, x = state[todo], label[todo]
            arc = s * self.labels + x
            found = np.minimum(np.searchsorted(self.arcs, arc), max(len(self.arcs) - 1, 0))
            hit = (self.arcs[found] == arc) & (s > 0) if len(self.arcs) else np.zeros(len(s), bool)
            root = s == 0
            weight[todo[hit]] += self.arc_weight[found[hit]]
            after[todo[hit]] = self.arc_next[found[hit]]
            weight[todo[root]] += self.root_weight[x[root]]
            after[todo[root]] = self.root_next[x[root]]
            missed = ~hit & ~root
            todo = todo[missed]
            weight[todo] += self.fail_weight[s[missed]]
            state = state.copy()
            state[todo] = self.fail_next[s[missed]]
        return after, weight

    def read(self, lines: Lines) -> np.ndarray:
        """Log10 weight of every token: lanes of LANE tokens are read side by side, each after the two tokens before it."""
        starts = np.flatnonzero(lines.place % LANE == 0)
        stops = np.minimum(starts + LANE, lines.end[lines.row[starts]])
        state, weights = np.zeros(len(starts), np.int64), np.zeros(len(lines.row))
        warm = np.minimum(lines.place[starts], 2)
        order = np.argsort(starts - stops, kind="stable")
        starts, warm, shortness = starts[order], warm[order], (starts - stops)[order]
        for step in range(-2, LANE):
            lanes = np.flatnonzero(-warm <= step) if step < 0 else np.arange(np.searchsorted(shortness, -step, "left"))
            if not len(lanes):
                if step < 0:
                    continue
                break
            at = starts[lanes] + step
            state[lanes], weight = self.follow(state[lanes], lines.word[at])
            if step >= 0:
                weights[at] = weight
        return weights


# ---- the exchange --------------------------------------------------------------------------------------------------------

RESULT = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def layout(sizes: dict[str, int]) -> tuple[int, int]:
    """(blocks, bits of a bucket): both grow with the square root of the corpus once it is large."""
    block = max(BLOCK_BYTES, int((sizes["n_bytes"] * ROOT) ** 0.5))
    blocks = max(1, -(-sizes["n_bytes"] // block))
    keys = max(BUCKET_KEYS, sizes["n_bytes"] // 2 // blocks)
    return blocks, max(0, int(np.ceil(np.log2(max(1, sizes["n_bytes"] / 2 / keys)))))


def score_texts(documents: DataFrame, weights=WEIGHTS, limit: int = SEGMENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document."""
    sizes = training_sizes(documents)
    blocks, bits = layout(sizes)
    spare = unused_bits(sizes["n_bytes"])
    texts = segments(documents, blocks, limit)

    def ask(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        lines = Lines(read_parts(rows), spare)
        cells = [(b, block, s.stop - s.start, pack_sorted(lines.keys[s]), pack(lines.train[s])) for b, s in _cells(lines.keys, bits)]
        return pa.table([pa.array(c) for c in zip(*cells)], names=["bucket", "block", "n", "keys", "train"])

    def answer(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        keys = np.concatenate([unpack_sorted(k, m) for k, m in zip(rows.column("keys").to_pylist(), n)])
        train = np.concatenate([unpack(t, m) for t, m in zip(rows.column("train").to_pylist(), n)])
        distinct, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=train, minlength=len(distinct))[which].astype(np.uint64)
        ends = np.cumsum(n)
        packed = [pack(total[low:high]) for low, high in zip(ends - n, ends)]
        return pa.table([rows.column("bucket"), rows.column("block"), rows.column("n"), pa.array(packed)], names=["bucket", "block", "n", "total"])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        rows = read_parts(rows)
        lines = Lines(rows, spare)
        answers = answers.sort_by("bucket")
        total = np.concatenate([unpack(t, n) for t, n in zip(answers.column("total").to_pylist(), answers.column("n").to_pylist())])
        total = total.astype(np.int64)
        if len(total) != len(lines.keys):
            raise RuntimeError("a block did not get an answer for each of its n-grams")
        read = Automaton(lines, total, sizes, weights).read(lines)
        counted, c = lines.counted, total[lines.word]
        base = np.log10(c + 1.0) - np.log10(sizes["train_tokens"] + sizes["train_types"] + 1.0)

        def summed(values):
            return np.bincount(lines.row[counted], weights=values[counted], minlength=lines.rows)

        columns = [pa.array(summed(np.ones(len(c))).astype(np.int64)), pa.array(summed(c > 0).astype(np.int64))]
        columns += [pa.array(summed(base)), pa.array(summed(read))]
        own = ["uid", "doc_id", "held_out"]
        return pa.table([*[rows.column(k) for k in own], *columns], names=[*own, "n_tokens", "n_known", "base_score", "score"])

    asked = texts.groupBy("block").applyInArrow(ask, "bucket long, block long, n long, keys binary, train binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "bucket long, block long, n long, total binary")
    parts = texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, RESULT)
    sums = parts.groupBy("uid", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(sizes["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
