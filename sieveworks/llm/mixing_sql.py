"""The mix of mixing.mix as SQL, for checking it in another engine."""

from __future__ import annotations


def _sainte_lague(rows: str, votes: str, seats: str, group: str, order: str, keep: str) -> str:
    part = f"PARTITION BY {group}" if group else ""
    return f"""(SELECT {keep}, low + coalesce(sum(won), 0)::BIGINT AS quota FROM (
      SELECT *, CASE WHEN k IS NOT NULL AND row_number() OVER ({part} ORDER BY {votes} / (2 * k - 1) DESC NULLS LAST, {order}, k) <= left_over THEN 1 ELSE 0 END AS won FROM (
      SELECT *, unnest(CASE WHEN high > low THEN generate_series(low + 1, high) ELSE [NULL::BIGINT] END) AS k FROM (
      SELECT *, {seats} - sum(low) OVER ({part}) AS left_over FROM (
      SELECT *, CASE WHEN share > 0 THEN greatest(ceil(share * ({seats} + p / 2.0::DOUBLE) + 0.5)::BIGINT, low) ELSE low END AS high FROM (
      SELECT *, greatest(floor(share * ({seats} - p / 2.0::DOUBLE) - 0.5), 0)::BIGINT AS low FROM (
      SELECT *, CASE WHEN v > 0 THEN {votes} / v ELSE 0.0 END AS share FROM (
      SELECT *, sum({votes}) OVER ({part})::DOUBLE AS v, count(*) OVER ({part}) AS p FROM {rows}))))))) GROUP BY {keep}, low)"""


def mix_sql(weights: tuple[float, ...] = (5, 2, 1), volume: float = 1.5, most: float = 2.0, block: int = 8, shard_words: int = 200_000, seed: int = 17, bucket: int = 1_000) -> str:
    w = ", ".join(f"{x}::DOUBLE" for x in weights)
    return rf"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
 ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1)),
 weighed AS (SELECT *, ([{w}])[rk % {len(weights)} + 1] AS w, source_size * {most}::DOUBLE AS cap FROM ranked),
 summed AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share_w, sum(source_size) OVER ()::DOUBLE * {volume}::DOUBLE AS total, row_number() OVER (ORDER BY cap / w, rk) AS nth FROM weighed),
 levelled AS (SELECT *, (total - before) / share_w AS lv FROM summed),
 targets AS (SELECT source, source_size, rk, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM (SELECT *, (SELECT arg_min(lv, nth) FROM levelled WHERE lv * w <= cap) AS level FROM levelled)),
 seats AS (SELECT *, round(sum(target) OVER () / {block})::BIGINT AS seats FROM targets),
 quotas AS {_sainte_lague("seats", "target", "seats", "", "rk", "source, source_size, rk, target, seats")},
 dealt AS (SELECT s.doc_id, s.size, q.source_size, q.target, q.rk, q.quota AS q, ('0x' || substr(md5(concat_ws(':', '{seed}', s.doc_id)), 1, 15))::BIGINT AS key, greatest(ceil(q.source_size / {shard_words}::DOUBLE), 1)::BIGINT AS n FROM sized AS s JOIN quotas AS q ON s.source IS NOT DISTINCT FROM q.source),
 shards AS (SELECT rk, key % n AS shard, (key % n) // {bucket} AS bucket, sum(size)::BIGINT AS words, any_value(q) AS q FROM dealt GROUP BY 1, 2, 3),
 buckets AS (SELECT rk, bucket, sum(words)::BIGINT AS votes, any_value(q) AS q FROM shards GROUP BY 1, 2),
 bucket_quotas AS {_sainte_lague("buckets", "votes", "q", "rk", "bucket", "rk, bucket, votes, q")},
 seated AS (SELECT s.rk, s.bucket, s.shard, s.words, b.quota AS seats FROM shards AS s JOIN bucket_quotas AS b ON s.rk = b.rk AND s.bucket = b.bucket),
 parts AS (SELECT *, least(quota // blocks, {int(most)}) AS full_passes, ('0x' || substr(md5(concat_ws(':', '{seed}', rk, shard)), 1, 15))::BIGINT % blocks AS first FROM (SELECT rk, shard, words, quota, greatest(ceil(words / {block}::DOUBLE), 1)::BIGINT AS blocks FROM {_sainte_lague("seated", "words", "seats", "rk, bucket", "shard", "rk, bucket, shard, words, seats")})),
 runs AS (SELECT *, CASE WHEN full_passes >= {int(most)} THEN 0 ELSE quota % blocks END AS run FROM parts),
 cuts AS (SELECT *, least(first * {block}, words) AS a0, least((first + run) * {block}, words) AS a1, least(greatest(first + run - blocks, 0) * {block}, words) AS b1 FROM runs),
 placed AS (SELECT d.*, c.full_passes, c.a0, c.a1, c.b1, sum(size) OVER (PARTITION BY c.rk, c.shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM dealt AS d JOIN cuts AS c ON d.rk = c.rk AND d.key % d.n = c.shard)
 SELECT doc_id, size, source_size, target, CAST(full_passes * size + greatest(least(e, a1) - greatest(e - size, a0), 0) + greatest(least(e, b1) - greatest(e - size, 0), 0) AS BIGINT) AS taken FROM placed"""
