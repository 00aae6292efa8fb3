"""Shared table expressions of the check queries, in the SQL dialect of the check engine."""

from __future__ import annotations

import re

from pointsman.operators.features import BINARY_PROBES, FAMILY_LABELS, FAMILY_PROBE, SCORE_PROBES

SYSTEMS = ("alpha", "beta", "gamma")
SEEDS = (1, 2, 3)
N_MODELS = 7
MODELS = [f"m{i}" for i in range(1, N_MODELS + 1)]
COST_SCALE = 50_000.0


def h(*parts: str) -> str:
    """The 32-bit hash draw of the given SQL expressions."""
    return f"CAST(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def h_text(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def unit(*parts: str) -> str:
    return f"(CAST({h(*parts)} AS DOUBLE) / 4294967296.0::DOUBLE)"


def mixed(key: str, i: str) -> str:
    """The counter draw below 2^31 of a 32-bit key."""
    mask = (1 << 31) - 1
    x = f"((({i}) * 2654435761 + ({key})) & {mask})"
    x = f"((xor({x}, {x} >> 15) * 739982445) & {mask})"
    x = f"((xor({x}, {x} >> 12) * 695872825) & {mask})"
    return f"xor({x}, {x} >> 15)"


def values(names) -> str:
    return ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))


def collapse(c: str) -> str:
    r"""White space runs to one blank. The test texts hold only the ASCII kinds."""
    return f"trim(regexp_replace({c}, '[\\s\\x0B\\x1C-\\x1F\\x85\\x{{A0}}]+', ' ', 'g'))"


CTES: dict[str, str] = {
    # Pool P, rectangular: parts as samples, line numbers as candidates.
    "p_samples": """SELECT CAST(p_partkey AS VARCHAR) AS sample_id, p_partkey AS key, CAST(p_size AS BIGINT) AS size,
        p_brand AS dataset, p_type AS domain, p_name AS query FROM part""",
    "p_raw": """SELECT CAST(l_partkey AS VARCHAR) AS sample_id, 'm' || l_linenumber AS model,
        CAST((sum(CAST(round(l_discount * 100) AS BIGINT)) * 100) // count(*) AS DOUBLE) / 1000 AS score,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*) AS DOUBLE) / 100 AS cost,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens
        FROM lineitem GROUP BY l_partkey, l_linenumber""",
    "p_ids": """SELECT sample_id FROM p_raw GROUP BY sample_id
        HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM p_raw)""",
    "ps": "SELECT * FROM p_samples WHERE sample_id IN (SELECT sample_id FROM p_ids)",
    "po": "SELECT o.*, s.dataset, s.domain FROM p_raw o JOIN ps s USING (sample_id)",
    "p_oracle": "SELECT sample_id, dataset, domain, max(score) AS oracle FROM po GROUP BY ALL",
    "runs": "SELECT seed, system FROM (VALUES "
    + ", ".join(f"({s})" for s in SEEDS)
    + ") a(seed), (VALUES "
    + ", ".join(f"('{s}')" for s in SYSTEMS)
    + ") b(system)",
    "pr": f"""SELECT seed, system, sample_id, dataset, domain, model, score, cost,
        {unit('seed', 'system', 'sample_id', 'model')} AS q,
        {unit("'cost'", 'seed', 'system', 'sample_id', 'model')} * {COST_SCALE}::DOUBLE AS c FROM po, runs""",
    "pk": """SELECT seed, system, sample_id, dataset, domain, model AS selected_model, score AS selected_score,
        oracle AS oracle_score, oracle - score AS regret, q - q2 AS prediction_margin FROM (
          SELECT *, row_number() OVER w AS rn, lead(q) OVER w AS q2,
            max(score) OVER (PARTITION BY seed, system, sample_id) AS oracle
          FROM pr WINDOW w AS (PARTITION BY seed, system, sample_id ORDER BY q DESC, model)) WHERE rn = 1""",
    "dm": "SELECT dataset, model, avg(score) AS acc FROM po GROUP BY ALL",
    "dm_best": "SELECT model, avg(acc) AS acc FROM dm GROUP BY model ORDER BY acc DESC, model LIMIT 1",
    "dm_x": """SELECT dataset, avg(acc) AS rnd, max(acc) AS dsbest,
        max(CASE WHEN model = (SELECT model FROM dm_best) THEN acc END) AS best,
        any_value(orc) AS orc
        FROM dm JOIN (SELECT dataset, avg(oracle) AS orc FROM p_oracle GROUP BY dataset) USING (dataset) GROUP BY dataset""",
    "bm": """SELECT seed, system, avg(router) * 100 AS AvgAcc,
        avg(CASE WHEN abs(rnd) > 1e-12 THEN router / rnd - 1 END) * 100 AS GainR,
        avg(CASE WHEN abs(best) > 1e-12 THEN router / best - 1 END) * 100 AS GainB,
        avg(CASE WHEN abs(orc) > 1e-12 THEN 1 - router / orc END) * 100 AS GapO,
        avg(best) * 100 AS BestSingleAvg, avg(dsbest) * 100 AS DatasetOracleAvg, avg(orc) * 100 AS OracleAvg,
        (SELECT model FROM dm_best) AS best_single_model, count(*) AS n_datasets, sum(n) AS n_test
        FROM (SELECT seed, system, dataset, avg(selected_score) AS router, count(*) AS n FROM pk GROUP BY ALL)
        JOIN dm_x USING (dataset) GROUP BY seed, system""",
    # Pool O, sparse: orders as samples, the latest line per number as the outcome.
    "o_samples": """SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderkey AS key, o_orderpriority AS dataset,
        o_orderstatus AS domain FROM orders""",
    "o_raw": """SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, 'm' || l_linenumber AS model,
        CAST(CAST(round(l_discount * 100) AS BIGINT) AS DOUBLE) / 10 AS score, l_extendedprice AS cost,
        l_shipdate, l_partkey, l_suppkey FROM lineitem""",
    "oo": """SELECT sample_id, model, score, cost, dataset, domain FROM (
          SELECT *, row_number() OVER (PARTITION BY sample_id, model
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, cost DESC, score DESC) AS rn FROM o_raw)
        JOIN o_samples USING (sample_id) WHERE rn = 1""",
    "os": "SELECT * FROM o_samples WHERE sample_id IN (SELECT sample_id FROM oo)",
    "opr": f"""SELECT s.sample_id, s.dataset, m.model, {unit("'q'", 's.sample_id', 'm.model')} AS q,
        {unit("'c'", 's.sample_id', 'm.model')} * {COST_SCALE}::DOUBLE AS c
        FROM os s, (SELECT 'm' || i AS model FROM range(1, {N_MODELS + 1}) r(i)) m""",
    # Pool D, texts: documents as samples, their labels as outcomes.
    "d_samples": "SELECT CAST(doc_id AS VARCHAR) AS sample_id, doc_id AS key, lang AS dataset, source AS domain, text AS query FROM documents",
    "d_out": """SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'quality' AS model, CAST(quality AS DOUBLE) AS score FROM labels
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic', CAST(toxic AS DOUBLE) FROM labels""",
    # Features of pool P by an arithmetic rule.
    "pf_noul": f"""SELECT sample_id, n.name AS probe, CAST((key * (2 * n.j + 3) + size * (n.j + 1)) % 11 AS DOUBLE) / 10 AS p
        FROM ps, (VALUES {values(BINARY_PROBES)}) n(j, name)""",
    "pf_score": f"""SELECT sample_id, key, probe, j, k, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY sample_id, probe) AS DOUBLE) AS p FROM (
        SELECT sample_id, key, n.name AS probe, n.j, l.k, 1 + (key * (l.k + 3) + size * (n.j + 1) + n.j * l.k) % 7 AS w
        FROM ps, (VALUES {values(SCORE_PROBES)}) n(j, name), range(0, 4) l(k))""",
    "pf_fam": f"""SELECT sample_id, key, label, CAST(w AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY sample_id) AS DOUBLE) AS p FROM (
        SELECT sample_id, key, f.label, 1 + (key * (f.k + 2) + size) % 5 AS w FROM ps, (VALUES {values(FAMILY_LABELS)}) f(k, label))""",
    "pf_long": f"""
        SELECT sample_id, probe, 'noul' AS stat, NULL AS level, p AS value FROM pf_noul
        UNION ALL SELECT sample_id, probe, 'entropy', NULL,
          ((CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) + (CASE WHEN p < 1 THEN -(1 - p) * ln(1 - p) ELSE 0 END)) / ln(2) FROM pf_noul
        UNION ALL SELECT sample_id, probe, 'p', CAST(k AS VARCHAR), p FROM pf_score
        UNION ALL SELECT sample_id, probe, 'entropy', NULL, sum(-p * ln(p)) / ln(4) FROM pf_score GROUP BY sample_id, probe
        UNION ALL SELECT sample_id, probe, 'expected', NULL, sum(k * p) FROM pf_score GROUP BY sample_id, probe
        UNION ALL SELECT sample_id, probe, 'spread', NULL, sqrt(greatest(0, sum(k * k * p) - sum(k * p) * sum(k * p))) FROM pf_score GROUP BY sample_id, probe
        UNION ALL SELECT sample_id, probe, 'score', NULL, CAST((key + j) % 4 AS DOUBLE) FROM pf_score WHERE k = 0
        UNION ALL SELECT sample_id, probe, 'confidence', NULL, CAST((key * (j + 1)) % 10 AS DOUBLE) / 10 FROM pf_score WHERE k = 0 AND (key * (j + 1)) % 10 <> 0
        UNION ALL SELECT sample_id, '{FAMILY_PROBE}', 'p', label, p FROM pf_fam
        UNION ALL SELECT sample_id, '{FAMILY_PROBE}', 'entropy', NULL, sum(-p * ln(p)) / ln({len(FAMILY_LABELS)}) FROM pf_fam GROUP BY sample_id
        UNION ALL SELECT sample_id, '{FAMILY_PROBE}', 'confidence', NULL, CAST(1 + key % 9 AS DOUBLE) / 10 FROM pf_fam WHERE label = '{FAMILY_LABELS[0]}'""",
    "pf": """SELECT sample_id, probe, stat, level,
        'sem_' || probe || '__' || stat || coalesce('__' || level, '') AS feature, value FROM pf_long""",
    "pf_entropy": f"SELECT sample_id, avg(value) AS uncertainty FROM pf_long WHERE stat = 'entropy' AND probe <> '{FAMILY_PROBE}' GROUP BY sample_id",
    "pm": f"SELECT sample_id, feature, value FROM pf WHERE stat IN ('noul', 'p') AND probe <> '{FAMILY_PROBE}'",
    "groups": f"""SELECT *, sha256(dataset || chr(0) || {collapse("query")}) AS leakage_group FROM ps""",
    # Two systems compared sample by sample.
    "pd": """SELECT a.sample_id, a.dataset, a.domain, a.selected_score AS score_a, b.selected_score AS score_b,
        a.selected_score - b.selected_score AS diff, g.leakage_group FROM pk a JOIN pk b USING (sample_id) JOIN groups g USING (sample_id)
        WHERE a.seed = 1 AND a.system = 'alpha' AND b.seed = 1 AND b.system = 'beta'""",
}


def needed(body: str) -> list[str]:
    """Names of the shared expressions a text uses, each after those it builds on."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit_one(name)

    def visit_one(name: str) -> None:
        for other in CTES:
            if other != name and re.search(rf"\b{other}\b", CTES[name]) and other not in order:
                visit_one(other)
        order.append(name)

    visit(body)
    return order


def compile_sql(body: str, columns: str) -> str:
    """A complete statement: the shared expressions, then the body, then its typed columns.

    The column name lambda is a reserved word there and is quoted, unless it starts a lambda.
    """
    body = re.sub(r'(?<!")\blambda\b(?!")(?!\s+\w+\s*[:,])', '"lambda"', body)
    parts = [f"{n} AS ({CTES[n]})" for n in needed(body)]
    parts.append(f"result AS ({body})")
    return f"WITH RECURSIVE {', '.join(parts)} SELECT {columns} FROM result"
