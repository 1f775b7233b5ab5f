"""Language-model scores from a weighted backoff automaton over word n-grams.

States are the n-gram contexts of the training text, arcs its n-grams.  A state h of c(h) occurrences
has an arc for each word that followed it, of probability (c(hw) + K p(w | h')) / (c(h) + K), and a
failure arc of weight K / (c(h) + K) to h', its context without the oldest word.  The root's arcs are
(c + 1) / (N + V + 1), for unknown words too, so every state's probabilities add up to one.  A text is
read from left to right once: the traversal carries its state, takes the arc of the next word or else
failure arcs until there is one, and adds up log10 weights.

No task holds the whole automaton and none is broadcast.  Documents are packed into blocks with word
numbers of their own; each block asks for the counts of its own n-grams, once each, by 64-bit hash.
Requests meet by ranges of the hash, where counts of all blocks are added up and answered in the order
asked; so a block gets exactly the part of the automaton that its documents can reach.

A request is one row for a block and a range.  Blocks and ranges both grow with the square root of the
corpus, so that about ``ROW_TOKENS`` words stand behind each row and rows grow as the input does, until
blocks reach ``MOST_TOKENS``, which bounds a task's memory; from there rows get thinner.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, crc_mod, ship, stored

ORDER, PRIOR = 2, 512.0
#: Words behind a request, on average; the least and the most words of a block; words of a range, in blocks.
ROW_TOKENS, LEAST_TOKENS, MOST_TOKENS, PART_BLOCKS = 10_000, 50_000, 2_000_000, 3
#: What sizes of blocks are chosen by; nothing else depends on it.
BYTES_A_WORD = 6
_BLOCK = "block long, doc_ids binary, held binary, lens binary, ids binary, dict binary, n_train long, n_all long"
_START, _END = b" ", b""  # neither can be a word


def block_tokens(tokens: int) -> int:
    """The words of a block for a corpus of so many."""
    return max(LEAST_TOKENS, min(MOST_TOKENS, math.isqrt(ROW_TOKENS * tokens // PART_BLOCKS)))


def _encode(rows: Iterator, most: int) -> Iterator:
    """Arrow batches of (doc_id, held_out, text) -> rows of _BLOCK of ``most`` words; each document is START, its words, END."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    names = [x.split()[0] for x in _BLOCK.split(", ")]
    part = TaskContext.get().partitionId() << 32
    made = 0

    def fresh() -> tuple:
        return {_START: 0, _END: 1}, [], [], [], []

    def packed(number: dict, docs: list, held: list, lens: list, ids: list):
        long = np.array(lens, dtype="<i4")
        hashes = np.fromiter(map(xxh64_intdigest, number, repeat(42)), dtype="<u8", count=len(number))
        train = int((long[~np.array(held, dtype=bool)] - 1).sum())
        row = [part | made, _ids(docs), np.array(held, dtype=bool).tobytes(), long.tobytes(), _pack(np.concatenate(ids)), hashes.tobytes(), train, int((long - 1).sum())]
        kinds = [pa.int64()] + [pa.binary()] * 5 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def _ids(docs: list) -> bytes:
        # the id's bits, and whether there is one
        return np.array([0 if x is None else x for x in docs], dtype="<i8").tobytes() + np.array([x is None for x in docs], dtype=bool).tobytes()

    number, docs, held, lens, ids = fresh()
    size = 0
    for batch in rows:
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = (text or "").encode().lower().split()
            own = np.fromiter((number.setdefault(w, len(number)) for w in found), dtype="<i4", count=len(found))
            ids.append(np.concatenate([[0], own, [1]]).astype("<i4"))
            docs.append(doc)
            held.append(out)
            lens.append(len(found) + 2)
            size += len(found) + 2
            if size >= most:
                yield packed(number, docs, held, lens, ids)
                number, docs, held, lens, ids = fresh()
                size, made = 0, made + 1
    if docs:
        yield packed(number, docs, held, lens, ids)


def _grams(ids, starts, dictionary, order: int) -> list:
    """For each length the hash of the n-gram that ends at each position, and which positions have one."""
    import numpy as np

    word = dictionary[ids]
    since = np.arange(len(ids), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    found = [(word, np.ones(len(ids), dtype=bool))]
    for k in range(1, order):
        x = np.roll(found[-1][0], 1) * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((x ^ (x >> np.uint64(32)), since >= k))
    return found


def _read(row: dict) -> tuple:
    import numpy as np

    lens = np.frombuffer(row["lens"], dtype="<i4").astype(np.int64)
    return _unpack(row["ids"], "<i4"), lens, np.cumsum(lens) - lens, np.frombuffer(row["dict"], dtype="<u8"), np.frombuffer(row["held"], dtype=bool)


def _pack(numbers) -> bytes:
    """Numbers byte plane by byte plane, compressed: high bytes repeat in counts, word numbers and sorted hashes."""
    import numpy as np
    import pyarrow as pa

    size = numbers.dtype.itemsize
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, size).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind: str):
    import numpy as np
    import pyarrow as pa

    planes = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def _rows(batches: Iterator) -> Iterator:
    """Rows as dicts, one in Python's memory at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _requests(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """(part, block, level, keys, counts): the distinct n-grams of a block and their counts in its training texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for row in _rows(batches):
            ids, lens, starts, dictionary, held = _read(row)
            train = np.repeat(~held, lens)
            out: list = []
            for level, (key, valid) in enumerate(_grams(ids, starts, dictionary, order), 1):
                keys, place = np.unique(key[valid], return_inverse=True)
                counts = np.bincount(place, weights=train[valid], minlength=len(keys)).astype("<u4")
                parts, first = np.unique((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), return_index=True)
                for p, a, b in zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
                    out.append((p, row["block"], level, _pack(keys[a:b]), _pack(counts[a:b])))
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["part", "block", "level", "keys", "counts"])

    return blocks.select("block", "lens", "ids", "dict", "held").mapInArrow(run, "part int, block long, level int, keys binary, counts binary")


def _answers(requests: DataFrame) -> DataFrame:
    """(part, block, level, totals, types): totals over all blocks in the order of the keys asked for.

    ``types`` is the number of distinct training words of the part, said once a part.
    """

    def run(group):
        import numpy as np
        import pyarrow as pa

        start = _start_hash()
        part, level, block = (group.column(c).to_pylist() for c in ("part", "level", "block"))
        keys, counts = group.column("keys"), group.column("counts")
        totals, types = [b""] * len(part), [0] * len(part)
        for n in sorted(set(level)):
            rows = [k for k, x in enumerate(level) if x == n]
            own = [_unpack(keys[k].as_py(), "<u8") for k in rows]
            _, place = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([_unpack(counts[k].as_py(), "<u4") for k in rows]))
            ends = np.cumsum([len(x) for x in own])
            for k, a, b in zip(rows, ends - [len(x) for x in own], ends):
                totals[k] = _pack(total[place[a:b]].astype("<u8"))
            if n == 1:
                words = np.unique(np.concatenate(own))
                types[rows[0]] = int((total[words != np.uint64(start)] > 0).sum())
        return pa.table({"part": pa.array(part, pa.int32()), "block": pa.array(block, pa.int64()), "level": pa.array(level, pa.int32()), "totals": pa.array(totals, pa.binary()), "types": pa.array(types, pa.int64())})

    return requests.groupBy("part").applyInArrow(run, "part int, block long, level int, totals binary, types long")


def _start_hash() -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(_START, 42)


def traverse(root: list, known: list, arcs: list, failures: list) -> float:
    """The log10 weight of a document, whose positions are START, its words and END.

    arcs[s][i] is the weight of the arc of word i from its context of s words, NaN if there is none;
    failures[s][i] that of the failure arc of that context.
    """
    order, total, s = len(arcs), 0.0, known[0]
    for i in range(1, len(root)):
        while s:
            x = arcs[s][i]
            if x == x:
                break
            total += failures[s][i]
            s -= 1
        if s:
            total += x
            if s + 1 < order:
                s += 1
        else:
            total += root[i]
            s = known[i]
    return total


def _scores(blocks: DataFrame, order: int, prior: float, n: int, types: int) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for row in _rows(batches):
            ids, lens, starts, dictionary, held = _read(row)
            answer = {(a["level"], a["part"]): a["totals"] for a in row["answers"]}
            counts = []
            for level, (key, valid) in enumerate(_grams(ids, starts, dictionary, order), 1):
                _, place = np.unique(key[valid], return_inverse=True)
                total = np.concatenate([_unpack(answer[k], "<u8") for k in sorted(answer) if k[0] == level])
                at = np.zeros(len(ids))
                at[valid] = total[place]
                counts.append(at)
            p = (counts[0] + 1) / (n + types + 1)
            base = np.log10(p)
            arcs, failures = [None], [None]
            for k in range(1, order):
                seen = np.roll(counts[k - 1], 1)  # of the context, the shorter n-gram before
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(seen > 0, (counts[k] + prior * p) / (seen + prior), p)
                    arcs.append(np.where(counts[k] > 0, np.log10(p), np.nan))
                    failures.append(np.log10(prior / (seen + prior)))
            known = ((counts[0] > 0) & (order > 1)).astype(np.int8)
            own = lambda x, a, b: x if x is None else x[a:b].tolist()
            score = [
                traverse(base[a:b].tolist(), known[a:b].tolist(), [own(x, a, b) for x in arcs], [own(x, a, b) for x in failures])
                for a, b in zip(starts.tolist(), (starts + lens).tolist())
            ]
            inner = np.ones(len(ids), dtype=bool)
            inner[starts] = False
            sums = lambda x: np.add.reduceat(np.where(inner, x, 0), starts)
            docs = np.frombuffer(row["doc_ids"][: 8 * len(lens)], dtype="<i8")
            none = np.frombuffer(row["doc_ids"][8 * len(lens) :], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs, pa.int64(), mask=none), pa.array(held), pa.array(lens - 1), pa.array(sums((counts[0] > 0).astype(np.int64))),
                    pa.array([n] * len(lens), pa.int64()), pa.array(sums(base)), pa.array(score, pa.float64()),
                ],
                [x.split()[0] for x in schema.split(", ")],
            )

    return blocks.mapInArrow(run, schema)


def score(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, held_out=None) -> DataFrame:
    """Score every row of ``docs``, learning from those that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with one added)
    and score.  By default rows whose crc32 of the id modulo 7 is 2 are held out; one without an id
    isn't.  A null text is empty and has the END token only.  Repeated rows count and are scored each.
    Without training rows the model knows no word.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / BYTES_A_WORD + F.count("*")).first()[0]
    most = block_tokens(int(size))
    blocks = stored(rows.mapInArrow(lambda batches: _encode(batches, most), _BLOCK), "lm-blocks", batch=TEXTS)
    n, tokens = blocks.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("n_all"), F.lit(0))).first()
    ranges = max(4, min(1 << 24, tokens // (PART_BLOCKS * most)))
    answers = stored(_answers(_requests(blocks, order, ranges)), "lm-answers")
    types = answers.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    own = answers.groupBy("block").agg(F.collect_list(F.struct("level", "part", "totals")).alias("answers"))
    return _scores(blocks.join(own, "block").select("doc_ids", "held", "lens", "ids", "dict", "answers"), order, prior, n, types)
