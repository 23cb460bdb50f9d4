"""op8_source_mixing: how many words the mixture takes of each of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import table
from lodestone.llm.mixing import BITS, BLOCK_WORDS, BUCKET_DOCS, CAP, HASH_BITS, MULT_A, MULT_B, ROUNDS, ROUNDS_SEED, SHARE, WEIGHTS, mixed_documents


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def _hashed(x: str, salt: str) -> str:
    mixed = f"((({x} + {salt}) & {BITS}) * {MULT_A} & {BITS})"
    return f"((xor({mixed}, {mixed} >> 15) * {MULT_B} & {BITS}) >> {31 - HASH_BITS})"


def _permuted(name: str, source: str) -> str:
    """CTEs that move column v of a relation with n, salt, a and b, where v is not done."""
    rounds = [f"{name}_0 AS (SELECT *, v // b AS l, v % b AS r FROM {source})"]
    for i in range(1, ROUNDS + 1):
        right = f"(r + {_hashed('l', f'(salt + {i * ROUNDS_SEED})')}) % b"
        left = f"(l + {_hashed('r', f'(salt + {(i + ROUNDS) * ROUNDS_SEED})')}) % a"
        rounds += [f"{name}_{i}r AS (SELECT * REPLACE ({right} AS r) FROM {name}_{i - 1})", f"{name}_{i} AS (SELECT * REPLACE ({left} AS l) FROM {name}_{i}r)"]
    moved = f"SELECT * EXCLUDE (l, r) REPLACE (CASE WHEN done THEN v ELSE l * b + r END AS v) FROM {name}_{ROUNDS}"
    return ",\n".join([*rounds, f"{name} AS (SELECT * REPLACE (v < n AS done) FROM ({moved}))"])


#: Passes that move only what is not yet in range; so many that none is left on these tables.
WALKS = 8


def mixing_sql(source: str = "documents") -> str:
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    folded = f"xor(coalesce(doc_id, 0) & {BITS}, (coalesce(doc_id, 0) >> 31) & {BITS})"
    n_buckets = f"greatest(1, ((SELECT count(*) FROM (SELECT DISTINCT source, doc_id, size FROM sizes)) + {BUCKET_DOCS - 1}) // {BUCKET_DOCS})"
    return rf"""
sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {source}),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE sid % {len(WEIGHTS)} {weight} END::BIGINT AS weight, {CAP} * source_size AS most FROM per),
leveled AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM weighed WINDOW o AS (ORDER BY most::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (
  SELECT *, most < weight * level AS capped,
         (SELECT arg_min(level, (most::DOUBLE / weight, sid)) FROM leveled WHERE NOT most < weight * level) AS final FROM leveled),
targets AS (
  SELECT source, sid, source_size, CASE WHEN capped THEN most::DOUBLE ELSE weight * final END AS target,
         ceil(source_size / {BLOCK_WORDS})::BIGINT AS n_blocks FROM settled),
slotted AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({CAP} * n_blocks, floor(n_blocks * target / source_size + 0.5)::BIGINT) ELSE 0 END AS n_slots FROM targets),
placed AS (
  SELECT doc_id, size, sid, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM (SELECT doc_id, size, sid, source_size, target, {_hashed(f"({_hashed(folded, str(ROUNDS_SEED))} + size)", '2')} % {n_buckets} AS bucket
        FROM sizes JOIN slotted ON sizes.source IS NOT DISTINCT FROM slotted.source)),
pieces AS (
  SELECT sid, block, doc_id, off, size, source_size, target,
         least(off + size, (block + 1) * {BLOCK_WORDS}) - greatest(off, block * {BLOCK_WORDS}) AS n_words
  FROM (SELECT *, unnest(range(off // {BLOCK_WORDS}, (off + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM placed WHERE size > 0)),
p AS (
  SELECT sid, n_blocks AS n, j % n_blocks AS v, {CAP} * sid + j // n_blocks AS salt, false AS done,
         ceil(sqrt(n_blocks::DOUBLE))::BIGINT AS a, ceil(n_blocks::DOUBLE / ceil(sqrt(n_blocks::DOUBLE)))::BIGINT AS b
  FROM (SELECT sid, n_blocks, unnest(range(0, n_slots)) AS j FROM slotted WHERE n_slots > 0)),
{",".join(_permuted(f"w{i}", f"w{i - 1}" if i else "p") for i in range(WALKS))},
times AS (SELECT sid, v AS block, count(*) AS times FROM w{WALKS - 1} GROUP BY sid, v)"""


ORACLE_SQL = {
    "op8_source_mixing": f"""WITH {mixing_sql()}
SELECT doc_id, size, source_size, target, sum(n_words * coalesce(times, 0))::BIGINT AS taken
FROM pieces LEFT JOIN times USING (sid, block) GROUP BY sid, off, doc_id, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, target, 0::BIGINT FROM placed WHERE size = 0"""
}
QUERIES = {"op8_source_mixing": op8_source_mixing}
