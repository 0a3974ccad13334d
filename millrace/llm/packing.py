"""Filling fixed-capacity containers with items (problem 6).

Pattern packing: documents are counted in tokens once; their sizes form a histogram of at most `capacity` entries, and
only that histogram reaches the driver. There, sizes are put into classes of equal shares of the tokens, patterns of few
classes whose mean sizes fill a container are enumerated, non-negative least squares fits how often to repeat each of
them, the repeats are rounded down, and each is filled with actual sizes to the last token. What is left is fitted again, and
at last packed best-fit decreasing into containers of its own. All of this works on runs of equal containers, so its cost
follows the number of distinct sizes, never the number of documents. The tasks then turn a document's rank among
documents of its size into its container by binary search.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import write_work

# Fixed value: the pre-tokenisation pattern that the byte-level vocabularies were made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of document lengths, different classes in a pattern, numbers of documents of a class that are tried, weight of full
#: containers in the fit, rounds of fitting, and share of more containers that a fit may need.
CLASSES, MIXED, STEPS, FULL, ROUNDS, SPARE = 24, 3, 3, 4.0, 4, 0.005
#: Texts above this many characters are counted in stretches cut before a single blank, where no token can cross.
STRETCH = 100_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > STRETCH and (m := _CUT.search(text, at + STRETCH)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(documents: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, n_tokens) under the byte-pair vocabulary in the file; null and empty texts have 0 tokens."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import base64

        import pyarrow as pa
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [sum(len(enc.encode_ordinary(s)) for s in stretches(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long")


def length_classes(histogram: Mapping[int, int], classes: int = CLASSES) -> list[tuple[list[int], float]]:
    """(sizes in rising order, mean size) of at most so many classes of about equal shares of the tokens."""
    total = sum(s * n for s, n in histogram.items())
    out: list[tuple[list[int], float]] = []
    own: list[int] = []
    tokens = count = 0
    done = 0
    for s in sorted(histogram):
        own.append(s)
        tokens += s * histogram[s]
        count += histogram[s]
        if (done + tokens) * classes >= total * (len(out) + 1):
            out.append((own, tokens / count))
            done += tokens
            own, tokens, count = [], 0, 0
    return out


def patterns(means: Sequence[float], capacity: int, most: int = MIXED, steps: int = STEPS) -> list[dict[int, int]]:
    """Ways to fill a container from few classes: {class: documents}, with up to `most` different classes whose mean sizes add
    up to the capacity or just under it, the last class taking the room that the others leave."""
    out: dict[tuple, dict[int, int]] = {}

    def thinned(n: int) -> list[int]:
        return sorted({max(1, round(n * k / steps)) for k in range(1, steps + 1)}) if n > 0 else []

    def grow(room: float, classes: Sequence[int], held: dict[int, int]) -> None:
        c, rest = classes[0], classes[1:]
        n = int(room / means[c])
        if not rest:
            if n:
                way = {**held, c: n}
                out.setdefault(tuple(sorted(way.items())), way)
            return
        for k in thinned(n):
            grow(room - k * means[c], rest, {**held, c: k})

    numbers = range(len(means) - 1, -1, -1)  # large documents first, so that small ones take the room that is left
    for m in range(1, most + 1):
        for some in combinations(numbers, m):
            grow(capacity, some, {})
    return list(out.values())


def nnls(a, b, rounds: int = 500):
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    import numpy as np

    m = a.shape[1]
    x, passive = np.zeros(m), np.zeros(m, dtype=bool)
    w = a.T @ b
    for _ in range(rounds):
        free = np.where(passive, -np.inf, w)
        if not (free > 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))).any():
            break
        passive[int(np.argmax(free))] = True
        while True:
            z = np.zeros(m)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (z[passive] > 0).all():
                break
            low = passive & (z <= 0)
            step = float(np.min(x[low] / np.maximum(x[low] - z[low], 1e-300)))
            x += step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
            if not passive.any():
                z = x
                break
        x = z
        w = a.T @ (b - a @ x)
    return x


Run = tuple[tuple[tuple[int, int], ...], int]


class _Bins:
    """Containers in runs of equal content, by free room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.bins: dict[int, dict[tuple, int]] = {}
        self.frees: list[int] = []

    def put(self, content: Mapping[int, int], n: int) -> None:
        free = self.capacity - sum(s * k for s, k in content.items())
        if free not in self.bins:
            self.bins[free] = {}
            insort(self.frees, free)
        key = tuple(sorted(content.items()))
        self.bins[free][key] = self.bins[free].get(key, 0) + n

    def best_fit(self, left: Mapping[int, int]) -> None:
        """Best-fit decreasing: every item into the fullest container that has room for it, or a new one."""
        for s in sorted(left, reverse=True):
            n = left[s]
            while n:
                k = bisect_left(self.frees, s)
                if k == len(self.frees):
                    fit = self.capacity // s
                    if n >= fit:
                        self.put({s: fit}, n // fit)
                    if n % fit:
                        self.put({s: n % fit}, 1)
                    break
                free = self.frees[k]
                content, m = next(iter(self.bins[free].items()))
                more = min(free // s, n)
                t = min(m, n // more)
                if t == m:
                    del self.bins[free][content]
                    if not self.bins[free]:
                        del self.bins[free], self.frees[k]
                else:
                    self.bins[free][content] = m - t
                held = dict(content)
                held[s] = held.get(s, 0) + more
                self.put(held, t)
                n -= t * more

    def runs(self) -> list[Run]:
        return [(c, n) for f in sorted(self.bins) for c, n in sorted(self.bins[f].items())]


def fitted_patterns(histogram: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int, list[tuple[list[int], float]]]]:
    """(pattern, repeats, classes) of the patterns that non-negative least squares chooses for a histogram, repeats rounded down.
    Besides the documents of each class it fits their tokens, as full containers, so that patterns without waste win."""
    import numpy as np

    classes = length_classes(histogram)
    have = np.array([float(sum(histogram[s] for s in own)) for own, _ in classes])
    means = [m for _, m in classes]
    ways = patterns(means, capacity)
    a = np.zeros((len(classes) + 1, len(ways)))
    for j, way in enumerate(ways):
        for c, k in way.items():
            a[c, j] = k / have[c]
        a[-1, j] = FULL * capacity / sum(s * n for s, n in histogram.items())
    x = nnls(a, np.array([1.0] * len(classes) + [FULL]))
    return [(way, int(r + 1e-9), classes) for way, r in zip(ways, x, strict=True) if r >= 1]


def pack_sizes(histogram: Mapping[int, int], capacity: int) -> tuple[list[Run], int]:
    """(runs, fitted): runs (((size, how many in a container), ...), containers) that hold every item of sizes 1..capacity
    exactly once, and how many of the containers, the first ones, were filled by fitted patterns. Of the fits with several
    rounds, with one and with none (the residual step alone), the one that fills most containers is taken among those that
    need at most SPARE more containers than the best of them."""
    tried = [(*_pack_sizes(histogram, capacity, r), r) for r in (ROUNDS, 1, 0)]
    number = [sum(n for _, n in runs) for runs, _, _ in tried]
    runs, fitted, _ = max((t for t, n in zip(tried, number, strict=True) if n <= min(number) * (1 + SPARE) + 1), key=lambda t: (t[1], t[2]))
    return runs, fitted


def _pack_sizes(histogram: Mapping[int, int], capacity: int, rounds: int) -> tuple[list[Run], int]:
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    if any(s > capacity for s in left):
        raise ValueError("items above the capacity must be split first")
    bins = _Bins(capacity)
    if not left:
        return [], 0
    fitted = left.pop(capacity, 0)  # a container by itself
    if fitted:
        bins.put({capacity: 1}, fitted)
    sizes = sorted(left)

    def take(near: float, room: int, held: Mapping[int, int], lo: int, hi: int) -> int:
        """The size nearest to what is wanted between two sizes, of which there is one more; 0 if there is none."""
        i = bisect_left(sizes, near)
        below = next((sizes[j] for j in range(min(i, len(sizes)) - 1, -1, -1) if left[sizes[j]] > held.get(sizes[j], 0)), 0)
        above = next((sizes[j] for j in range(i, len(sizes)) if left[sizes[j]] > held.get(sizes[j], 0)), 0)
        fit = [x for x in (below, above) if lo <= x <= min(hi, room)]
        return min(fit, key=lambda x: abs(x - near), default=0)

    def pair(near: float, room: int, held: Mapping[int, int], first: tuple[int, int], second: tuple[int, int]) -> tuple[int, ...]:
        """Two sizes that fill the room, the first as near as can be to what is wanted; none if no two do."""
        lo, hi = bisect_left(sizes, first[0]), bisect_right(sizes, first[1])
        mid = min(max(bisect_left(sizes, near), lo), hi)
        up, down = mid, mid - 1
        while up < hi or down >= lo:
            if up < hi and (down < lo or sizes[up] - near <= near - sizes[down]):
                s, up = sizes[up], up + 1
            else:
                s, down = sizes[down], down - 1
            t = room - s
            if second[0] <= t <= second[1] and left.get(t, 0) > held.get(t, 0) + (s == t) and left[s] > held.get(s, 0):
                return s, t
        return ()

    def fill_pattern(way: Mapping[int, int], repeats: int, classes: Sequence[tuple[list[int], float]]) -> int:
        """Containers filled by a pattern: every document is chosen so that what is left of the room suits those still to come."""
        parts = [c for c in sorted(way, reverse=True) for _ in range(way[c])]
        reach = [(classes[max(0, c - 1)][0][0], classes[min(len(classes) - 1, c + 1)][0][-1]) for c in parts]
        tail = [0.0]
        for c in reversed(parts):
            tail.append(tail[-1] + classes[c][1])
        tail.reverse()
        done = 0
        while done < repeats and sizes:
            held: dict[int, int] = {}
            room = capacity
            for j, c in enumerate(parts):
                if room == 0:
                    break
                if j == len(parts) - 2 and (two := pair(room * classes[c][1] / tail[j], room, held, reach[j], reach[j + 1])):
                    for s in two:
                        held[s] = held.get(s, 0) + 1
                    room = 0
                    break
                last = j == len(parts) - 1
                s = take(room + 1 if last else room * classes[c][1] / tail[j], room, held, *reach[j])
                if not s:
                    break
                held[s] = held.get(s, 0) + 1
                room -= s
            for s in sorted(held) if room else ():  # exchange one document for another that is longer by what is left
                t = s + room
                if left.get(t, 0) > held.get(t, 0):
                    held[s] -= 1
                    held[t] = held.get(t, 0) + 1
                    if not held[s]:
                        del held[s]
                    room = 0
                    break
            if room:
                break  # a fitted container is full; what cannot fill one is left to the next round or to the residual step
            n = min([repeats - done, *(left[s] // k for s, k in held.items())])
            for s, k in held.items():
                left[s] -= n * k
                if not left[s]:
                    del left[s], sizes[bisect_left(sizes, s)]
            bins.put(held, n)
            done += n
        return done

    # patterns of large documents come first: small ones remain to fill what is left
    for _ in range(rounds):  # what the rounded repeats leave over is fitted again
        before = fitted
        for way, repeats, classes in sorted(fitted_patterns(left, capacity) if left else [], key=lambda f: -max(f[0])):
            fitted += fill_pattern(way, repeats, classes)
        if fitted == before:
            break
    rest = _Bins(capacity)
    rest.best_fit(left)
    return bins.runs() + rest.runs(), fitted


def _slots(runs: list[Run]):
    """Sorted (size, first rank) -> first container, as arrays, and the number of containers."""
    import numpy as np

    rows, base = [], 0
    rank: dict[int, int] = {}
    for content, n in runs:
        for s, k in content:
            for _ in range(k):
                rows.append((s, rank.get(s, 0), base))
                rank[s] = rank.get(s, 0) + n
        base += n
    rows.sort()
    return (*(np.array([r[j] for r in rows], dtype=np.int64) for j in range(3)), base)


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, container_no, first_token, n_tokens, fitted): every item in exactly one container of the capacity;
    fitted says whether a fitted pattern filled the container.

    Only an item larger than the capacity is split, into full containers and one remaining piece that is packed like
    an item. Items of size 0 (or null) take no room and lie in container 0. Rows are items: a repeated key is
    packed as often as it occurs. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    kind = dict(items.dtypes)[key]
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    pieces = items.select(F.col(key), n.alias("n_")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil(F.col("n_") / F.lit(capacity)) - 1).cast("int")))))
    first = F.col("piece_no").cast("bigint") * capacity
    salts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.select(key, "piece_no", first.alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n_") - first).alias("n_tokens")).withColumn("salt", F.pmod(F.xxhash64(key, "piece_no"), F.lit(salts)).cast("int"))
    # ranks within a size: a size that holds a third of all rows is spread over the salts
    counts = pieces.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt")) - F.col("n")).drop("n")
    sizes = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    runs, fitted = pack_sizes(sizes, capacity)
    slots = items.sparkSession.sparkContext.broadcast(_slots(runs))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy(key, "piece_no")))
    ranked = ranked.join(offsets, ["n_tokens", "salt"]).select(key, "piece_no", "first_token", "n_tokens", (F.col("r") - 1 + F.col("offset")).alias("rank"))

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        s, lo, base, _ = slots.value
        bounds = np.searchsorted(s, np.arange(capacity + 2))
        for b in batches:
            size_, rank = (b.column(j).to_numpy() for j in (3, 4))
            to = np.zeros(len(size_), dtype=np.int64)
            order = np.argsort(size_, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(size_[order])) + 1) if len(order) else ():
                if (v := int(size_[part[0]])) > 0:
                    i, j = bounds[v], bounds[v + 1]
                    at = i + np.searchsorted(lo[i:j], rank[part], side="right") - 1
                    to[part] = base[at] + rank[part] - lo[at]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(to), b.column(2), b.column(3), pa.array((to < fitted) & (size_ > 0))], names=[key, "piece_no", "container_no", "first_token", "n_tokens", "fitted"])

    return ranked.mapInArrow(place, f"`{key}` {kind}, piece_no int, container_no long, first_token long, n_tokens long, fitted boolean")


def packed_documents(documents: DataFrame, windows: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(window_name, key, piece_no, container_no, first_token, n_tokens, fitted) for every row of windows (window_name,
    capacity_tokens): a table of a few settings. Tokens are counted once for all windows."""
    counted = write_work(token_counts(documents, key, text, vocabulary), "tokens")
    out = None
    for w in windows.where("capacity_tokens >= 1").distinct().collect():
        one = pack(counted, key, "n_tokens", w["capacity_tokens"]).select(F.lit(w["window_name"]).alias("window_name"), key, "piece_no", "container_no", "first_token", "n_tokens", "fitted")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else documents.sparkSession.createDataFrame([], f"window_name string, `{key}` {dict(documents.dtypes)[key]}, piece_no int, container_no long, first_token long, n_tokens long, fitted boolean")


def fill(packed: DataFrame) -> DataFrame:
    """(window_name, n_containers, n_tokens, n_fitted): how many containers each window took, and how many of them fitted
    patterns filled."""
    number = F.col("container_no")
    return packed.groupBy("window_name").agg(F.countDistinct(number).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct(F.when(F.col("fitted"), number)).alias("n_fitted"))
