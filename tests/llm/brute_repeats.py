"""Holds operator 10 against brute force on a whole table: python -m tests.llm.brute_repeats DIR... (under 30 bytes of memory per byte of text).

Every window of 400 bytes is hashed and counted, without samples or buckets. It also says how many documents share a run
of 51 words with another place, and how many of those have no repeated 400-byte string.
"""

import hashlib
import sys
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow.parquet as pq

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
BATCH = 48 << 20


def repeated_starts(data, table, ends, length):
    """Whether the window of ``length`` values table[data] from each place, within its document, occurs at another place too.

    Windows are hashed in batches of whole documents and sorted a range of hashes at a time, so ten bytes a window are held at once.
    """
    begins = np.concatenate([[0], ends[:-1]])
    cuts = [0]
    while cuts[-1] < len(ends):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, begins[cuts[-1]] + BATCH, "right"))))
    most = max((int(ends[d - 1] - begins[c]) for c, d in zip(cuts, cuts[1:])), default=0)
    power = np.full(most + 1, BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for c, d in zip(cuts, cuts[1:]):
        low, high = int(begins[c]), int(ends[d - 1])
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * power[: high - low], out=total[1:])
        inside = np.zeros(high - low + 1, np.int32)
        long_enough = ends[c:d] - begins[c:d] >= length
        np.add.at(inside, begins[c:d][long_enough] - low, 1)
        np.add.at(inside, ends[c:d][long_enough] - low - length + 1, -1)
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        # S(i + length) - S(i) is the window's hash times BASE^i; BASE^(most - i) brings all to one power.
        window = (total[at + length] - total[at]) * power[most - at]
        window ^= window >> np.uint64(31)
        window *= np.uint64(0xD6E8FEB86659FD93)
        window ^= window >> np.uint64(32)
        places.append((at + low).astype(np.uint32 if len(data) < 1 << 32 else np.int64))
        windows.append(window)
    places, windows = np.concatenate(places[1:] or places), np.concatenate(windows)
    part = (windows >> np.uint64(58)).astype(np.uint8)
    mark = np.zeros(len(data), bool)

    def sort(k):
        chosen = np.flatnonzero(part == k)
        values = windows[chosen]
        order = np.argsort(values)
        same = values[order[1:]] == values[order[:-1]]
        mark[places[chosen[order[1:][same]]]] = True
        mark[places[chosen[order[:-1][same]]]] = True

    with ThreadPoolExecutor(6) as threads:
        list(threads.map(sort, range(64)))
    return mark


def brute(texts, length=400):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of every text."""
    rng = np.random.default_rng(7)
    table = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    starts = np.flatnonzero(repeated_starts(data, table, ends, length))
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    cut = np.cumsum(step[:-1], dtype=np.int32) > 0
    out = []
    for a, b, text in zip(begins.tolist(), ends.tolist(), texts):
        c = cut[a:b]
        spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if b > a else 0
        out.append((b - a, int(c.sum()), spans, hashlib.sha256(data[a:b][~c].tobytes() if spans else text).hexdigest()))
    return out


def shared_passages(texts, words=51):
    """Whether each text holds a run of ``words`` words that occurs at another place too."""
    numbers, lists = {}, []
    for t in texts:
        lists.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in t.split()), np.int32))
    table = np.random.default_rng(8).integers(1, 1 << 63, len(numbers) + 1, dtype=np.uint64)
    ends = np.cumsum([len(x) for x in lists])
    begins = ends - [len(x) for x in lists]
    before = np.concatenate([[0], np.cumsum(repeated_starts(np.concatenate(lists), table, ends, words))])
    return (before[ends] > before[begins]).tolist()


def main(folders):
    from pyspark.sql import SparkSession

    from evidar.llm.substrings import op10_repeated_substrings

    conf = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "32", "spark.ui.enabled": "false"}
    spark = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    found = {}
    for folder in folders:
        got = op10_repeated_substrings(spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").toArrow()
        found[folder] = sorted(map(str, zip(*(got.column(c).to_pylist() for c in got.column_names))))
    spark.stop()
    for folder, got in found.items():
        table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
        texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        ids = table.column("doc_id").to_pylist()
        want = brute(texts)
        differ = sum(a != b for a, b in zip(got, sorted(map(str, ((i, *w) for i, w in zip(ids, want))))))
        shared = shared_passages(texts)
        print(
            f"{folder}: {len(got)} of {len(ids)} rows, {differ} differ; {sum(w[1] > 0 for w in want)} documents lose {sum(w[1] for w in want)} bytes; "
            f"{sum(shared)} share 51 words, {sum(s and not w[1] for s, w in zip(shared, want))} of them no 400 bytes; "
            f"{sum(w[1] > 0 and not s for s, w in zip(shared, want))} lose bytes without sharing 51 words", flush=True,
        )


if __name__ == "__main__":
    main(sys.argv[1:])
