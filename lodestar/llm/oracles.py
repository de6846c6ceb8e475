"""SQL for DuckDB of operators whose SQL is made by rule."""

from __future__ import annotations

from lodestar.llm import vector_codes as V


def vector_codes() -> str:
    """Product codes by rounds of nearest entries and means; sums of products of integers are exact in doubles."""
    nearest = """
near{r} AS MATERIALIZED (SELECT p.rid, p.part, arg_min(e, (d, e)) AS e, min(d)::BIGINT AS d FROM (
  SELECT p.rid, p.part, e, list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.v) + list_dot_product(c.v, c.v) AS d FROM parts p JOIN book{r} c USING (part)) p GROUP BY 1, 2)"""
    mean = """,
sums{r} AS MATERIALIZED (SELECT part, e, place, sum(x)::HUGEINT AS s, count(*) AS n FROM (
  SELECT part, e, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM parts JOIN near{r} USING (rid, part)) GROUP BY 1, 2, 3),
book{n} AS MATERIALIZED (SELECT part, e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
  SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY place)::DOUBLE[] AS v FROM sums{r} GROUP BY 1, 2) m USING (part, e))"""
    rounds = ",".join(nearest.format(r=r) + (mean.format(r=r, n=r + 1) if r < V.ROUNDS else "") for r in range(V.ROUNDS + 1))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({V.SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, part, list_slice(v, part * len(v) // {V.PARTS} + 1, (part + 1) * len(v) // {V.PARTS})::DOUBLE[] AS v FROM kept, range({V.PARTS}) t(part)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS e, v FROM parts WHERE rid <= {V.ENTRIES}),{rounds},
coded AS (SELECT rid, string_agg(lower(format('{{:02x}}', e)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{V.ROUNDS} GROUP BY 1),
digest AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, e, place)) AS codebooks_sha256 FROM (SELECT part, e, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM book{V.ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), digest
"""
