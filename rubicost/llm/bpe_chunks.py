"""Byte-level BPE encoding and decoding by overlapping chunks.

Texts up to ``chunk`` characters are pre-tokenised at once. A longer text is
cut into chunks that overlap the next one; Spark deals the chunks out and each
is pre-tokenised on its own. A text's chunks are then stitched: pre-tokens
depend only on the text after their start, so from the first place where two
neighbours agree on a boundary inside their overlap they agree for good. Where
the overlap holds no common boundary (one very long pre-token), matching goes
on from the last sure boundary until it meets one of the next chunk's. The
stitched pieces are encoded by merging the pair of lowest rank, leftmost first;
pieces that are new to a task go through these rounds together, as arrays.
Decoding joins the raw bytes of the ids. A text of up to ``chunk`` characters is
one chunk: its pre-tokens are final, there being no neighbour to stitch it to.
Each Python worker has one encoder, which remembers the ids of the pieces that
it has met in any task (at most ``limit`` of them, then it starts anew).

Defined results: a null text is encoded as the empty text, that is no ids;
repeated rows and null ids stay as they are (a long one is encoded once); an empty table gives no rows;
null ids decode to no bytes; other columns are ignored. The vocabulary file is
read on the driver, whose size bounds the broadcast (under 1 MB).
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubicost.llm.common import map_slices, saved, slices, text_key

CHUNK = 32_768
OVERLAP = 1_024


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 token, space, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


WIDTHS = (6, 8, 10, 12, 16, 24, 32)
NEVER = (1 << 31) - 1
#: how ids are held
ID = np.dtype("<i4")


class Pairs:
    """The rank of the token that two adjacent tokens make, for all pairs that make one, and the ids of single bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        found = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.keys = np.array([k for k, _ in found] or [-1], dtype=np.int64)
        self.made = np.array([r for _, r in found] or [NEVER], dtype=np.int32)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        self.of_bytes = np.array([ranks.get(bytes([i, j]), NEVER) for i in range(256) for j in range(256)], dtype=np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NEVER`` where they make no token or a side is missing (negative)."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], NEVER)


def merge_many(pieces: list[bytes], pairs: Pairs, width: int) -> list[bytes]:
    """As ``merge``, for many pieces of at most ``width`` bytes at once: each round merges one pair of every piece."""
    n = len(pieces)
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    place = np.arange(width)
    parts = np.where(place < sizes[:, None], pairs.bytes[raw], np.int32(-1))
    rank = np.full((n, width), NEVER, dtype=np.int32)
    rank[:, :-1] = np.where(place[1:] < sizes[:, None], pairs.of_bytes[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]], NEVER)
    done, live = np.full((n, width), -1, dtype=np.int32), np.arange(n)
    while len(live):
        at = rank.argmin(axis=1)
        least = rank[np.arange(len(live)), at]
        go = least < NEVER
        if not go.all():
            done[live[~go]] = parts[~go]
            parts, rank, live, at, least = parts[go], rank[go], live[go], at[go], least[go]
        rows = np.arange(len(live))
        # the right one of the two goes, and what follows moves up; the pair's own rank goes
        parts[rows, at] = least
        moved = np.minimum(place + (place > at[:, None]), width - 1)
        parts = np.take_along_axis(parts, moved, axis=1)
        parts[:, -1] = -1
        rank = np.take_along_axis(rank, np.minimum(place + (place >= at[:, None]), width - 1), axis=1)
        rank[:, -1] = NEVER
        rank[rows, at] = pairs.ranks(least, parts[rows, np.minimum(at + 1, width - 1)])
        some = at > 0
        rank[rows[some], at[some] - 1] = pairs.ranks(parts[rows[some], at[some] - 1], least[some])
    raw, step = done.astype(ID).tobytes(), 4 * width
    return [raw[at : at + 4 * k] for at, k in zip(range(0, step * n, step), (done >= 0).sum(axis=1).tolist(), strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    follow, before, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = follow[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue
        alive[j], ends[i], follow[i] = False, end, follow[j]
        if follow[i] < n:
            before[follow[i]] = i
        for k in (before[i], i):
            if k >= 0 and follow[k] < n and (r := ranks.get(piece[k : ends[follow[k]]])) is not None:
                heapq.heappush(heap, (r, k, ends[follow[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = follow[i]
    return out


class Encoder:
    """Encodes pre-tokens; their ids, as bytes of 32 bits each, are remembered until they are too many."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: Pairs | None = None, limit: int = 100_000) -> None:
        self.ranks, self.pattern, self.pairs, self.limit = ranks, regex.compile(pattern), pairs or Pairs(ranks), limit
        self.seen: dict[str, bytes] = {}
        self.bytes = token_bytes(ranks)

    def learn(self, pieces: Iterable[str]) -> None:
        """Merges the pieces that aren't remembered, those of like length together."""
        by: dict[int, list[str]] = {}
        for p in pieces:
            raw = p.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.seen[p] = whole.to_bytes(4, "little")
            elif len(raw) > WIDTHS[-1]:
                self.seen[p] = np.array(merge(raw, self.ranks), dtype=ID).tobytes()
            else:
                by.setdefault(next(w for w in WIDTHS if len(raw) <= w), []).append(p)
        for width, own in by.items():
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                self.seen.update(zip(some, merge_many([p.encode() for p in some], self.pairs, width), strict=True))

    def encode_all(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts given as their pre-tokens."""
        if len(self.seen) > self.limit:
            self.seen.clear()
        self.learn(set().union(*texts) - self.seen.keys())
        return [np.frombuffer(b"".join(map(self.seen.__getitem__, pieces)), dtype=ID) for pieces in texts]

    def encode(self, pieces: list[str]) -> np.ndarray:
        return self.encode_all([pieces])[0]

    def ends(self, text: str, start: int = 0) -> Iterator[int]:
        """End of each pre-token from ``start`` on."""
        return (m.end() for m in self.pattern.finditer(text, start))


OWN: dict[str, Encoder] = {}


def own_encoder(shared: tuple[dict[bytes, int], Pairs], pattern: str) -> Encoder:
    """This Python worker's encoder for a vocabulary; only the last one used is held."""
    held = OWN.get(pattern)
    if held is None or held.ranks is not shared[0]:
        OWN.clear()
        held = OWN[pattern] = Encoder(shared[0], pattern, shared[1])
    return held


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Arrays of ids as one Arrow column."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, ID), *rows]), pa.int32()))


def stitch(text: str, starts: list[int], stops: list[int], ends: list[list[int]], encoder: Encoder) -> list[int]:
    """Ends of all pre-tokens of a text from those of its overlapping chunks.

    Chunk i covers text[starts[i]:stops[i]]; ends[i] are its boundaries there,
    counted from the text's start. Those at the very end of a chunk may be cut
    short or see too little ahead, so the last two are not trusted.
    """
    out: list[int] = []
    sure = 0  # all boundaries up to here are settled
    for i, own in enumerate(ends):
        own = own if stops[i] == len(text) else own[:-2]
        if i:
            # from here the chunk's boundaries hold if it has a boundary at the last settled one
            at = bisect_left(own, sure)
            if sure != starts[i] and (at == len(own) or own[at] != sure):
                inside = set(own)
                stop = own[-1] if own else sure
                for end in encoder.ends(text, sure):
                    out.append(end)
                    sure = end
                    if end in inside or end >= stop:
                        break
                if sure not in inside:
                    continue
        fresh = own[bisect_right(own, sure) :]
        if fresh:
            # keep to what the next chunk can meet
            limit = starts[i + 1] if i + 1 < len(starts) else len(text)
            cut = bisect_left(fresh, limit) + 1 if i + 1 < len(starts) else len(fresh)
            nxt = set(ends[i + 1][:-2] if i + 1 < len(ends) and stops[i + 1] != len(text) else ends[i + 1]) if i + 1 < len(ends) else set()
            while cut < len(fresh) and fresh[cut - 1] not in nxt:
                cut += 1
            out += fresh[:cut]
            sure = out[-1]
    if sure < len(text):
        out += encoder.ends(text, sure)
    return out


def token_bytes(ranks: dict[bytes, int]) -> np.ndarray:
    """The raw bytes of each id."""
    of = np.empty(max(ranks.values(), default=-1) + 1, dtype=object)
    for raw, i in ranks.items():
        of[i] = raw
    return of


def decoded(ids: np.ndarray, ends: list[int], of: np.ndarray) -> pa.Array:
    """The joined bytes of consecutive lists of ids that end at ``ends``."""
    raw = of[ids].tolist()
    return pa.array([b"".join(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)], pa.binary())


def encode_documents(documents: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = False) -> DataFrame:
    """doc_id and ids (array of int), one row for each row of documents; with ``decode`` also data, what the ids decode to.

    Decoding in the same tasks spares sending all ids to a second Python worker.
    """
    more = ", data binary" if decode else ""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((ranks, Pairs(ranks)))
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def whole():
        encoder = own_encoder(shared.value, pattern)

        def work(cols):
            rows = encoder.encode_all([encoder.pattern.findall(t) for t in cols["text"]])
            data = {"data": decoded(np.concatenate([np.zeros(0, ID), *rows]), np.cumsum([*map(len, rows)], dtype=int).tolist(), encoder.bytes)} if decode else {}
            return {"doc_id": cols["doc_id"], "ids": lists(rows)} | data

        return work

    short = map_slices(docs.where(F.length("text") <= chunk), whole, f"doc_id long, ids array<int>{more}")

    def cut():
        encoder = own_encoder(shared.value, pattern)

        def work(cols):
            ends = [[a + e for e in encoder.ends(p)] for p, a in zip(cols["piece"], cols["start"], strict=True)]
            return {k: cols[k] for k in ("doc_id", "tk", "times", "start", "piece")} | {"ends": ends}

        return work

    def join(group: pd.DataFrame) -> pd.DataFrame:
        encoder = own_encoder(shared.value, pattern)
        group = group.sort_values("start")
        starts = group["start"].tolist()
        text = "".join(p[:chunk] for p in group["piece"])
        stops = [a + len(p) for a, p in zip(starts, group["piece"], strict=True)]
        ends = stitch(text, starts, stops, [list(e) for e in group["ends"]], encoder)
        ids = encoder.encode([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        data = {"data": [b"".join(encoder.bytes[ids].tolist())]} if decode else {}
        return pd.DataFrame({"doc_id": pd.array([group["doc_id"].iloc[0]], dtype="Int64"), "times": [group["times"].iloc[0]], "ids": [ids]} | data)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text is read once, from its start to its end
        for batch in batches:
            for doc_id, tk, times, text in zip(*(batch.column(i) for i in range(4)), strict=True):
                text = text.as_py()
                starts = range(0, len(text), chunk)
                for at in range(0, len(starts), 32):
                    some = list(starts[at : at + 32])
                    k = len(some)
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id.as_py()] * k, pa.int64()), "tk": pa.array([tk.as_py()] * k), "times": pa.array([times.as_py()] * k), "start": pa.array(some, pa.int32()), "piece": pa.array([text[x : x + chunk + overlap] for x in some])})

    chunks = once(docs.where(F.length("text") > chunk).withColumn("tk", text_key())).mapInArrow(pieces, "doc_id long, tk long, times long, start int, piece string")
    dealt = chunks.repartition("doc_id", "tk", "start")
    found = map_slices(dealt, cut, "doc_id long, tk long, times long, start int, piece string, ends array<int>", rows=8)
    stitched = found.groupBy("doc_id", "tk", "times").applyInPandas(join, f"doc_id long, times long, ids array<int>{more}")
    again = stitched.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")
    return short.unionByName(again)


def once(long: DataFrame) -> DataFrame:
    """doc_id, tk, times, text: rows of one id and text once, with their number.

    Numbers are counted without the texts; only texts that do come again are
    brought together.
    """
    several = saved(long.groupBy("doc_id", "tk").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), "times"))
    single = long.select("doc_id", "tk", F.lit(1).cast("long").alias("times"), "text")
    if several.isEmpty():
        return single
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t"))
    first = long.join(several, same).groupBy("doc_id", "tk", "times").agg(F.first("text").alias("text"))
    return single.join(several, same, "left_anti").unionByName(first)


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids and data: the raw bytes of the ids, joined."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("data", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = token_bytes(shared.value)
        for batch in batches:
            for part in slices(batch, 256, 1 << 22):
                ids = part.column(1)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy()).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), ids.cast(schema.field(1).type), decoded(ids.flatten().to_numpy(), ends, of)], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, ids array<int>, data binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ids and their decoded bytes."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
