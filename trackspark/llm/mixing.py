"""Mixing sources to target weights by Poisson replication.

Every row is repeated a Poisson-distributed number of times whose mean is its source's repetition rate, target rows
over rows. The number inverts the distribution at a uniform value hashed from seed, doc_id and text, so it depends
on neither partitions nor order. Copies are then ordered by a hash, which shuffles them globally.

Null source: a source of its own. Null doc_id or text: hashed as empty. Rows that are alike are repeated alike.
Without target weights all sources weigh the same; a source without a weight gets none. An empty table gives an
empty result. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import helpers, staged


@dataclass(frozen=True)
class Mixture:
    """``size``: rows wanted over rows given. Rates over ``part`` are inverted in equal parts, each with its own hash."""

    weights: dict[str, float] = field(default_factory=dict)
    size: float = 1.0
    seed: int = 17
    part: float = 16.0
    broadcast_sources: int = 10_000


#: A part's inversion ends here at the latest; at a mean of 16 the rest has a probability below 1e-16.
MOST = 64


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from the first 13 hexadecimal digits of an MD5."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def reached(mean: Column) -> Column:
    """The probabilities that a Poisson variable is at most 0, 1, ... MOST - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST - 1)), start, step, lambda acc: acc["all"])


def poisson(reached: Column, u: Column) -> Column:
    """The least k at which the distribution reaches ``u``, MOST at the most."""
    return F.size(F.filter(reached, lambda x: x < u))


def rates(docs: DataFrame, how: Mixture) -> DataFrame:
    """source, its repetition rate, the number of equal parts it is inverted in, and the distribution of a part."""
    counts = docs.groupBy(F.col("source").alias("__source")).agg(F.count("*").alias("__n"))
    if how.weights:
        listed = docs.sparkSession.createDataFrame(list(how.weights.items()), "__name string, __weight double")
        weighed = counts.join(listed, F.col("__source").eqNullSafe(F.col("__name")), "left").select("__source", "__n", F.coalesce("__weight", F.lit(0.0)).alias("__weight"))
    else:
        weighed = counts.withColumn("__weight", F.lit(1.0))
    rows, weight = weighed.agg(F.sum("__n"), F.sum("__weight")).first()
    share = F.try_divide(F.col("__weight") * F.lit(float(rows or 0) * how.size), F.lit(float(weight or 0)) * F.col("__n"))
    rate = F.coalesce(share, F.lit(0.0))
    parts = F.greatest(F.lit(1), F.ceil(rate / F.lit(how.part)).cast("int"))
    found = weighed.select("__source", rate.alias("__rate"), parts.alias("__parts"))
    # A source's distribution is laid out once, not for each of its rows.
    return found.withColumn("__reached", reached(F.col("__rate") / F.col("__parts")))


def replicated(docs: DataFrame, how: Mixture = Mixture(), rate: str = "rate", copy: str = "copy") -> DataFrame:
    """The rows of ``docs``, with their source's rate and the number of the copy (1 ... the number drawn), shuffled globally.

    Columns of ``docs`` named like these two are replaced; other names can be given.
    """
    own = helpers(docs)
    found = staged(rates(docs, how), "rates")
    found = found.select(*(F.col(c).alias(own + c[2:]) for c in found.columns))
    if found.limit(how.broadcast_sources + 1).count() <= how.broadcast_sources:
        found = F.broadcast(found)
    names = [x for x in docs.columns if x not in (rate, copy)]
    joined = docs.select(*names).join(found, F.col("source").eqNullSafe(F.col(f"{own}source")), "inner")
    content = F.md5(F.coalesce(F.col("text"), F.lit("")))
    # The uniform values come first: a lambda evaluates what it names again for each element, hashes of the text included.
    values = F.transform(F.sequence(F.lit(1), F.col(f"{own}parts")), lambda j: uniform(F.lit(how.seed), F.col("doc_id"), content, j))
    drawn = F.aggregate(values, F.lit(0), lambda acc, u: acc + poisson(F.col(f"{own}reached"), u))
    drawn = joined.withColumn(f"{own}drawn", drawn).where(F.col(f"{own}drawn") > 0)
    copies = drawn.select(*names, F.col(f"{own}rate").alias(rate), F.explode(F.sequence(F.lit(1), F.col(f"{own}drawn"))).alias(copy))
    # Dealt and sorted by a hash: a random order over all partitions, in one pass over the text.
    order = F.md5(F.concat_ws(":", F.lit(-how.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), copy, F.xxhash64("text")))
    return copies.withColumn(f"{own}order", order).repartition(f"{own}order").sortWithinPartitions(f"{own}order").drop(f"{own}order")


#: The same rows in DuckDB's SQL, for the default mixture.
SQL = """
with n as (select source, count(*) as n from documents group by source),
r as (select source, (select sum(n) from n)::double / ((select count(*) from n)::double * n) as rate from n),
d as (select d.*, rate, greatest(1, ceil(rate / 16.0))::int as parts from documents d join r on d.source is not distinct from r.source),
u as (select doc_id, source, text, rate, parts, j,
             (('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || ':' || j), 1, 13))::bigint + 0.5) / pow(16::double, 13) as u
      from d, lateral (select unnest(range(1, parts + 1)) as j)),
c as (select doc_id, source, text, rate, j, u, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1) as p from u, (select unnest(range(0, 65)) as k)),
s as (select doc_id, source, text, rate, j, u, k, sum(p) over (partition by doc_id, j order by k) as reached from c),
t as (select doc_id, source, text, rate, count(*) filter (reached < u) as drawn from s group by all)
select doc_id, source, text, unnest(range(1, drawn + 1))::int as copy from t where drawn > 0
"""
