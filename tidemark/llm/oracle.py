"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidemark.llm.subset import DIMS

_SPLIT = "lower(trim({}))"

_RECORDS = f"""
    rec AS (SELECT datum_id, arg_min(ROW({_SPLIT.format('split')}, label), ROW(ingested_at IS NULL, ingested_at)) AS r FROM datum WHERE datum_id IS NOT NULL GROUP BY 1),
    d AS (SELECT datum_id, r[1] AS split, r[2] AS label FROM rec WHERE r[1] IS NOT NULL AND r[2] IS NOT NULL),
    c AS (SELECT split, label, count(*) AS n FROM d GROUP BY 1, 2),
    p AS (SELECT split, sum(n) AS total FROM c GROUP BY 1),
    q AS (SELECT t.plan_id, {_SPLIT.format('t.split')} AS split, t.label, coalesce(c.n, 0) AS available,
                 greatest(coalesce(min_records, 0)::DOUBLE, coalesce(target_share * sample_percent / 100.0 * p.total, 0)) AS wanted
          FROM label_targets t LEFT JOIN c ON c.split = {_SPLIT.format('t.split')} AND c.label = t.label LEFT JOIN p ON p.split = {_SPLIT.format('t.split')})
"""


def _unit(seed: int, *cols: str) -> str:
    values = ", ".join(f"coalesce({c}::VARCHAR, '~')" for c in cols)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {values})), 1, 13))::BIGINT / 4503599627370496.0)"


def _code(bits: int) -> str:
    x = "float_data[{}]::DOUBLE"
    term = lambda j, o: " + ".join(x.format((j + bits * (o + p)) % DIMS + 1) for p in range(3))
    return " + ".join(f"CASE WHEN {term(j, 0)} > {term(j, 3)} THEN {1 << j} ELSE 0 END" for j in range(bits))


def oracle_sql() -> dict[str, str]:
    finite = "len(list_filter(float_data, lambda v: v IS NOT NULL AND isfinite(v)))"
    return {
        "p1_found": f"WITH {_RECORDS} SELECT plan_id, label FROM q WHERE available < wanted",
        "p1_report": f"""WITH {_RECORDS} SELECT plan_id, label, available, wanted, CAST(least(available, ceil(wanted - 1e-9)) AS BIGINT) AS drawn,
            greatest(0.0, wanted - least(available, ceil(wanted - 1e-9))) AS deficit FROM q""",
        "p1_sample": f"""WITH {_RECORDS}, s AS (SELECT plan_id, datum_id, d.label, least(available, ceil(wanted - 1e-9)) AS quota,
                row_number() OVER (PARTITION BY plan_id, d.label ORDER BY {_unit(1, 'plan_id', 'datum_id')}, datum_id) AS n FROM d JOIN q ON q.split = d.split AND q.label = d.label)
            SELECT plan_id, datum_id, label FROM s WHERE n <= quota""",
        "p3_subset": f"""WITH v AS (SELECT DISTINCT datum_id, {_SPLIT.format('split')} AS split, label, CAST({_code(10)} AS INT) AS code FROM datum
                WHERE datum_id IS NOT NULL AND len(float_data) = {DIMS} AND {finite} = {DIMS} AND len(list_filter(float_data, lambda v: v <> 0)) > 0),
            r AS (SELECT job_id, n_records AS k, datum_id, label, code, row_number() OVER (PARTITION BY job_id, label, code ORDER BY {_unit(3, 'datum_id')}, datum_id) AS rank
                FROM v JOIN subset_jobs j ON j.split IS NULL OR {_SPLIT.format('j.split')} = v.split WHERE n_records > 0),
            c AS (SELECT job_id, label, code, {_unit(4, 'label', 'code')} AS h FROM r WHERE rank = 1),
            t AS (SELECT *, row_number() OVER (PARTITION BY job_id, code ORDER BY h, label) AS turn FROM c),
            o AS (SELECT *, row_number() OVER (PARTITION BY job_id, turn, label ORDER BY h, code) AS round FROM t),
            z AS (SELECT r.*, row_number() OVER (PARTITION BY r.job_id ORDER BY rank, turn, round, h, r.label, r.code) AS place
                FROM r JOIN o ON o.job_id = r.job_id AND o.code = r.code AND o.label IS NOT DISTINCT FROM r.label)
            SELECT job_id, place, datum_id, label, code FROM z WHERE place <= k""",
    }
