"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule;
policies, which are versioned sets of bits, and ablations are bitwise operations on the ledger and never
look at texts again, once it is stored (``write_ledger``). No stage shuffles: a document's figures come from its own row.

Defined results: null text has no words, and so fails the base rule on length; a very long text is measured whole, in
one row; of equal lines and windows the first counts as the original, whichever it is; repeated rows give repeated
results; an empty table gives none; a null key stays null; no other column is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.spread import spread

#: White space of words, as a class of a regular expression.
_SPACE = r"[ \t\n\x0B\f\r]"


def measured(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_letters, n_upper,
    n_marks): one row per document."""
    base = spread(df.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")))
    base = base.withColumns(
        {
            "_words": F.array_remove(F.split("_text", _SPACE + "+"), ""),
            "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")),
        }
    )
    # The places of three-word windows, sorted by the window's hash and then by place: each value holds the
    # upper bits of the hash over the place; _bits is what the places need.
    base = base.withColumn("_n3", F.greatest(F.size("_words") - 2, F.lit(0)))
    base = base.withColumn("_bits", F.length(F.bin(F.col("_n3"))))
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    upper = F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("_bits"))
    base = base.withColumn("_upper", upper)
    none = F.array().cast("array<bigint>")
    base = base.withColumn(
        "_sorted",
        F.when(
            F.col("_n3") > 1,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_n3") - 1), lambda i: window(i).bitwiseAND(F.col("_upper")).bitwiseOR(i.cast("long")))),
        ).otherwise(none),
    )
    same = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.col("_upper")) == 0, F.lit(False))
    base = base.withColumn(
        "_twice", F.filter("_sorted", lambda x, i: same(x, F.get("_sorted", i + 1)) | F.when(i > 0, same(x, F.get("_sorted", i - 1))).otherwise(False))
    )
    base = base.withColumn("_repeats", F.when(F.size("_twice") == 0, none).otherwise(_places(same)))
    covered = F.aggregate(
        F.transform("_repeats", lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get("_repeats", i + 1) - x, F.lit(3).cast("bigint")))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    chars = F.length(F.array_join("_words", ""))
    return base.select(
        F.col("_key").alias(key),
        F.size("_words").cast("long").alias("n_words"),
        chars.cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (chars - F.regexp_count("_text", F.lit(r"[!-@\[-`{-~]"))).cast("long").alias("n_letters"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit("[!?|]")).cast("long").alias("n_marks"),
    )


def _places(same) -> Column:
    """The sorted places of windows that occur twice or more. Neighbours whose upper bits agree are compared
    word by word; if the words of any differ, all those windows are compared by their words instead."""
    place = lambda x: x.bitwiseAND(F.bitwise_not(F.col("_upper"))).cast("int")
    text = lambda x: F.slice("_words", place(x) + 1, F.lit(3))
    clash = F.exists(
        F.transform("_twice", lambda x, i: F.when(i > 0, same(x, F.get("_twice", i - 1)) & (text(x) != text(F.get("_twice", i - 1)))).otherwise(False)),
        lambda x: x,
    )
    full = F.array_sort(F.transform("_twice", lambda x: F.struct(text(x).alias("t"), place(x).cast("bigint").alias("p"))))
    equal = lambda x, y: F.coalesce(x["t"] == y["t"], F.lit(False))
    exact = F.filter(full, lambda x, i: equal(x, F.get(full, i + 1)) | F.when(i > 0, equal(x, F.get(full, i - 1))).otherwise(False))
    return F.sort_array(F.when(clash, F.transform(exact, lambda x: x["p"])).otherwise(F.transform("_twice", lambda x: place(x).cast("bigint"))))


@dataclass(frozen=True)
class Rule:
    """Bit ``bit`` is set where ``fails`` (SQL over the measurements) holds."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "mean_word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule(5, "few_letters", "10 * n_letters < 6 * word_chars"),
    Rule(6, "capitals", "10 * n_upper > 6 * word_chars"),
    Rule(7, "marks", "10 * n_marks > 5 * n_words"),
)
BASE_MASK = 0b11
#: Versions of the policy: a document is kept if none of these bits is set.
POLICIES = {"base": BASE_MASK, "v1": 0b11111111, "lenient": 0b00110111}


def ledger(measurements: DataFrame, rules=RULES) -> DataFrame:
    """The measurements and ``failed``, a bit per failed rule."""
    mask = F.lit(0).cast("long")
    for r in rules:
        mask = mask.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measurements.withColumn("failed", mask)


def write_ledger(led: DataFrame, path: str) -> DataFrame:
    """The ledger as a table below ``path``, for policies and ablations to come."""
    led.write.mode("overwrite").parquet(path)
    return led.sparkSession.read.schema(led.schema).parquet(path)


def with_policy(led: DataFrame, policy: str = "v1", policies=POLICIES) -> DataFrame:
    """``base_failed`` and ``kept`` under a version of the policy, and that version. What fails the base rules is never
    kept."""
    return led.withColumns(
        {"policy": F.lit(policy), "base_failed": F.col("failed").bitwiseAND(F.lit(BASE_MASK)) != 0, "kept": F.col("failed").bitwiseAND(F.lit(policies[policy] | BASE_MASK)) == 0}
    )


def ablations(led: DataFrame, policy: str = "v1", rules=RULES, policies=POLICIES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that nothing else of the policy rejects
    (which would be kept without the rule). One row per rule whatever the input; one pass over the masks."""
    mask = policies[policy]
    active = [r for r in rules if mask >> r.bit & 1]
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    sums = led.agg(
        *[F.count_if(hit.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"f{r.bit}") for r in active],
        *[F.count_if(hit == F.lit(1 << r.bit)).alias(f"o{r.bit}") for r in active],
    )
    rows = ", ".join(f"struct({r.bit} as bit, '{r.name}' as rule, f{r.bit} as n_failed, o{r.bit} as n_only)" for r in active)
    return sums.selectExpr(f"inline(array({rows}))")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    led = with_policy(ledger(measured(docs)))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed", "policy")




OP8_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents),
w as (select doc_id, rid, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from t),
p as (select rid, unnest(range(0, greatest(len(words) - 2, 0))) as i, words from w),
g as (select rid, i, count(*) over (partition by rid, words[i + 1], words[i + 2], words[i + 3]) as c from p),
d as (select rid, i, lead(i) over (partition by rid order by i) as nxt from g where c > 1),
r as (select rid, sum(least(3, coalesce(nxt - i, 3))) as n from d group by rid),
m as (select doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(r.n, 0)::bigint as n_repeat_words,
    (length(text) - length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')))::bigint as n_marked,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper,
    (length(text) - length(regexp_replace(text, '[!?|]', '', 'g')))::bigint as n_marks
    from w left join r using (rid)),
l as (select *, word_chars - n_marked as n_letters from m),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 10 * n_symbols > 3 * n_words then 4 else 0 end + case when 10 * n_dup_lines > 3 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words or word_chars > 20 * n_words then 16 else 0 end
    + case when 10 * n_letters < 6 * word_chars then 32 else 0 end + case when 10 * n_upper > 6 * word_chars then 64 else 0 end
    + case when 10 * n_marks > 5 * n_words then 128 else 0 end)::bigint as failed from l)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed, 'v1' as policy from f
"""
