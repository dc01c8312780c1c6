"""Host-level quality rules, in DataFrame functions only.

Each document is measured by itself; failures are then counted by host, the hosts' failure rates
are shrunk towards each other with a beta prior estimated from all hosts (method of moments), and
the verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.llm.common import SPACE_CLASS, cut, free_names

#: A document needs this many words.
MIN_WORDS = 50
#: Per cent of a document's words that may stand in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: A host whose shrunk failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.5
#: A hot host's rows are dealt to this many keys when its verdict is joined back.
SALTS = 32

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body's lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def window_hash(*three: Column) -> Column:
    return F.xxhash64(*three)


def repeat_starts(words: Column) -> Column:
    """Starts, ascending, of the 3-word windows found at least twice in the array.

    The windows' hashes are packed with their positions into longs, which take as many bits as the
    document's length asks for, and sorted, so equal windows become neighbours: n log n in the length
    of a document. Neighbours with one hash are compared by their words. Should windows of different
    words have one hash, they are sorted by their words too, so the result is exact at every length.
    """
    n = F.size(words) - 2
    bits = F.greatest(F.lit(1), F.ceil(F.log2(n + 1))).cast("int")
    high = F.call_function("shiftleft", F.lit(-1).cast("long"), bits)
    low = F.bitwise_not(high)

    def three(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(3)]

    def alike(i: Column, j: Column) -> Column:
        return (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    def next_one(keys: Column) -> Column:
        """For each window: 0 if the next one has another hash, 1 if it has the same words, 2 if only the hash is the same."""

        def look(k: Column, j: Column) -> Column:
            other = F.get(keys, j + 1)
            one_hash = k.bitwiseXOR(other).bitwiseAND(high) == 0
            return F.when(F.coalesce(one_hash, F.lit(False)), F.when(alike(k.bitwiseAND(low).cast("int"), other.bitwiseAND(low).cast("int")), 1).otherwise(2)).otherwise(0)

        return F.transform(keys, look)

    def by_words() -> Column:
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.struct(*three(i)).alias("w"), i.alias("i"))))
        same = lambda keys, k, j: F.coalesce(k["w"] == F.get(keys, j)["w"], F.lit(False))
        return let(keys, lambda keys: F.transform(F.filter(keys, lambda k, j: same(keys, k, j - 1) | same(keys, k, j + 1)), lambda k: k["i"]))

    def repeated(keys: Column) -> Column:
        marked = lambda marks: F.filter(keys, lambda _, j: (F.get(marks, j) == 1) | F.coalesce(F.get(marks, j - 1) == 1, F.lit(False)))
        starts = lambda marks: F.transform(marked(marks), lambda k: k.bitwiseAND(low).cast("int"))
        return let(next_one(keys), lambda marks: F.when(F.array_contains(marks, 2), by_words()).otherwise(starts(marks)))

    packed = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: window_hash(*three(i)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.sort_array(let(packed, repeated)))


def covered_words(starts: Column) -> Column:
    """Words inside the 3-word windows that begin at ``starts`` (ascending)."""
    steps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of anything but ASCII white space. A null text has no words and fails; an empty
    table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    found = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            let(repeat_starts(w), covered_words).alias("n_repeat_words"),
        ),
    )
    df = documents.withColumns(
        {
            "_found": found,
            "word_chars": F.length(F.translate(body, SPACES, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    )
    df = df.withColumns({"n_words": F.col("_found.n_words"), "n_repeat_words": F.col("_found.n_repeat_words")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed).drop("_found")


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: n, failed, and rate shrunk by a beta prior that all hosts give.

    The prior's mean and variance are those of the hosts' raw rates (each host counting once, the
    binomial part of the variance taken off). Hosts that all agree give a strong prior. A null host
    is a host of its own.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    prior = hosts.agg(
        F.avg(raw).alias("_m"),
        F.var_pop(raw).alias("_v"),
        F.avg(raw * (1 - raw) / F.col("n")).alias("_noise"),
    )
    spread = F.greatest(F.col("_v") - F.col("_noise"), F.lit(1e-6))
    weight = F.greatest(F.col("_m") * (1 - F.col("_m")) / spread - 1, F.lit(1.0))
    prior = prior.select(F.col("_m"), weight.alias("_w"))
    # one row against one row per host
    return hosts.join(F.broadcast(prior)).select("host", "n", "failed", ((F.col("failed") + F.col("_m") * F.col("_w")) / (F.col("n") + F.col("_w"))).alias("rate"))


def judge(measured: DataFrame, host: str = "source") -> DataFrame:
    """``measured`` with host_rate and kept: not base_failed, and a host whose shrunk rate is at most MAX_HOST_RATE.

    The verdicts are joined on (host, salt), so that a host with a third of all rows is dealt to
    SALTS keys. ``measured`` is read twice: pass a table or a checkpoint.
    """
    rates = host_rates(measured, host).select("host", F.col("rate").alias("host_rate"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = measured.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    joined = salted.join(rates, salted[host].eqNullSafe(rates["host"]) & (salted["_salt"] == rates["_salt"])).drop("_salt", "host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE))


def host_quality(documents: DataFrame, text: str = "text", host: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, measures, host_rate and kept for each document; the texts are measured once and only numbers are shuffled.

    Null text: no words, fails. Null host: a host of its own. Repeated rows are judged alike.
    Empty table: no rows. Further columns of ``documents`` are ignored, whatever their names.
    """
    slim = documents.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(host).alias("_host"), F.col(text).alias("_text"))
    measured = cut(measure(slim, "_text").drop("_text"))
    judged = judge(measured, "_host").drop("_host")
    return judged.withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keys)})


def filter_documents(documents: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that the rules keep, all columns as they were.

    Verdicts come back by document id and text hash, null-safe, so repeated rows stay or go together.
    """
    (own,) = free_names(documents, "_text_hash")
    marked = documents.withColumn(own, F.xxhash64(F.col(text)))
    kept = host_quality(marked, text, host, (doc_id, own)).where("kept").select(F.col(doc_id).alias("_id"), F.col(own).alias("_hash")).distinct()
    return marked.join(kept, marked[doc_id].eqNullSafe(kept["_id"]) & marked[own].eqNullSafe(kept["_hash"]), "left_semi").drop(own)
