"""What lies inside images without a table of contents: processor updates known by their sums, and logs of variables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .phoenix import byte, offsets_of, word
from .relations import follow

#: Bytes of an update's header and of the least update, and where its fields stand.
UPDATE_LEAST, DAY_AT, MONTH_AT, SIGNATURE_AT, FLAGS_AT, DATA_AT, TOTAL_AT, UPDATE_UNIT = 2048, 10, 11, 12, 24, 28, 32, 1024
#: A store's mark and head, a variable's mark and head, and the status of one in use.
STORE, STORE_HEAD, VARIABLE, VARIABLE_HEAD, ACTIVE = "$VSS", 16, "\xAA\x55", 34, 0x7F


def _number(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return sum(data[at + k].astype(np.int64) << 8 * k for k in range(4))


def find_updates(raw: bytes) -> list[tuple]:
    """(place, date, signature, flags, size) of the processor updates in an image, the first first.

    Every place is tried that has a date in its header and sizes that can be; the sums of all of them come from one array of prefix sums
    for each alignment. From the end on, an update is taken if it ends before the one taken last.
    """
    data = np.frombuffer(raw, np.uint8)
    n = len(data) - UPDATE_LEAST + 1
    if n <= 0:
        return []
    day, month = data[DAY_AT : DAY_AT + n], data[MONTH_AT : MONTH_AT + n]
    at = np.flatnonzero((1 <= month) & (month <= 0x12) & (1 <= day) & (day <= 0x31) & (data[DATA_AT : DATA_AT + n] & 3 == 0) & (data[TOTAL_AT : TOTAL_AT + n] == 0))
    held, total = _number(data, at + DATA_AT), _number(data, at + TOTAL_AT)
    size = np.where(held == 0, UPDATE_LEAST, total)
    fits = (total % UPDATE_UNIT == 0) & (size >= UPDATE_LEAST) & (size % 4 == 0) & (at + size <= len(data))
    at, size = at[fits], size[fits]
    good = np.zeros(len(at), bool)
    for k in range(4):
        own = np.flatnonzero(at % 4 == k)
        if len(own):
            words = np.frombuffer(raw, "<u4", (len(data) - k) // 4, k).astype(np.uint64)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(words)])
            first = at[own] // 4
            good[own] = (sums[first + size[own] // 4] - sums[first]) % np.uint64(1 << 32) == 0
    out, limit = [], len(data)
    for a, z in zip(at[good][::-1].tolist(), size[good][::-1].tolist()):
        if a + z <= limit:
            d = raw[a + 8 : a + 12].hex()
            out.append((a, f"{d[2:4]}{d[:2]}-{d[6:]}-{d[4:6]}", *(int.from_bytes(raw[a + x : a + x + 4], "little") for x in (SIGNATURE_AT, FLAGS_AT)), z))
            limit = a
    return out[::-1]


def updates(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, place, date, signature, flags, size): the processor updates in each artifact of ``files``, by ``find_updates``.

    Their bytes are ``substring(content, place + 1, size)``. An update's words add up to 0. Null and short contents have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *u) for p, c in zip(b["path"], b["c"]) for u in find_updates(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "place", "date", "signature", "flags", "size"])

    rows = files.filter(F.octet_length(content) >= UPDATE_LEAST).select("path", F.col(content).alias("c"))
    return rows.mapInPandas(run, "path string, place long, date string, signature long, flags long, size long")


def variables(files: DataFrame, work: str, content: str = "content") -> DataFrame:
    """(path, store, n, place, name, owner, status, value, summed, latest): the variables of each store, in the order in which they were written.

    A store is a log: a variable tells its sizes and the next begins where it ends; the log ends where no mark stands. ``summed``
    says whether a variable's sum is right, with its status as in use. ``latest`` is the last variable of an owner and name that
    is in use and has the right sum. A store that says to be longer than its artifact is none. ``work`` is shared.
    """
    spark, folder = files.sparkSession, f"{work.rstrip('/')}/variables-{uuid.uuid4().hex}"
    long = lambda d, at: word(d, at) + 65536 * word(d, at + 2).cast("long")
    rows = files.filter(F.contains(F.col(content), F.lit(STORE.encode()))).select("path", F.col(content).alias("c"))
    stores = rows.select("path", F.explode(offsets_of(F.col("c"), STORE)).alias("store"), "c").withColumn("bytes", long(F.col("c"), F.col("store") + 4))
    stores = stores.filter(F.col("bytes") < F.octet_length("c") - F.col("store"))
    stores = stores.select("path", "store", F.substring("c", F.col("store") + STORE_HEAD + 1, F.greatest(F.col("bytes") - STORE_HEAD, F.lit(0)).cast("int")).alias("log"))
    stores.write.parquet(f"{folder}/stores")
    stores = spark.read.schema(stores.schema).parquet(f"{folder}/stores").withColumn("g", F.concat_ws("|", "path", F.col("store").cast("string")))
    marks = F.filter(F.sequence(F.lit(0), F.greatest(F.octet_length("log") - VARIABLE_HEAD, F.lit(0))), lambda i: F.substring(F.col("log"), i + 1, F.lit(2)) == F.lit(VARIABLE.encode("latin-1")))
    found = stores.select("g", "log", F.explode(marks).alias("at"))
    sizes = found.select("g", F.col("at").cast("long").alias("node"), long(F.col("log"), F.col("at") + 8).alias("names"), long(F.col("log"), F.col("at") + 12).alias("values"), F.octet_length("log").alias("all"))
    known = sizes.withColumn("next", F.col("node") + VARIABLE_HEAD + F.col("names") + F.col("values")).filter("next <= all")
    known.write.parquet(f"{folder}/known")
    known = spark.read.schema(known.schema).parquet(f"{folder}/known")
    links = known.select("g", "node", "next").join(known.select("g", F.col("node").alias("next")), ["g", "next"])
    starts = known.filter("node = 0").select("g", F.lit(0).cast("long").alias("start"), "node")
    chain = follow(starts, links, "g", f"{folder}/follow").join(known, ["g", "node"]).join(stores, "g")
    record = chain.select("path", "store", F.col("step").alias("n"), "node", "names", F.substring("log", (F.col("node") + 1).cast("int"), (F.col("next") - F.col("node")).cast("int")).alias("r"))
    r = F.col("r")
    name = F.substring_index(F.decode(F.substring(r, F.lit(VARIABLE_HEAD + 1), F.col("names").cast("int")), "UTF-16LE"), "\0", 1)
    status, value = word(r, 2), F.substring(r, (F.col("names") + VARIABLE_HEAD + 1).cast("int"), F.octet_length(r))
    # The sum is over the record as it was written: in use, and without the sum itself.
    pairs = F.sequence(F.lit(0), F.ceil(F.octet_length(r) / 2).cast("int") - 1)
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda a, k: a + F.when(k == 1, ACTIVE).when(k == VARIABLE_HEAD // 2 - 1, 0).otherwise(byte(r, 2 * k) + 256 * F.coalesce(byte(r, 2 * k + 1), F.lit(0))))
    rows = record.select(
        "path", "store", "n", (F.col("store") + STORE_HEAD + F.col("node")).alias("place"), name.alias("name"), F.hex(F.substring(r, 17, 16)).alias("owner"), status.alias("status"), value.alias("value"),
        (F.pmod(-total, F.lit(65536)) == word(r, VARIABLE_HEAD - 2)).alias("summed"),
    )
    live = F.when(F.col("summed") & (F.col("status") == ACTIVE), F.col("n"))
    newest = F.max(live).over(Window.partitionBy("path", "store", "owner", "name"))
    return rows.withColumn("latest", F.coalesce(live == newest, F.lit(False)))
