"""The registered queries again as plain SQL for another engine, written independently of the operators."""

from __future__ import annotations

import re

from hostweave.plans.catalog import CENTROIDS, DIRTY_VIEW, FLOW_VIEW, N_ROLES
from hostweave.sources.schema import ATTRIBUTES, BOT_LABEL, FEATURES, NORMAL_LABEL, SYNTH_COLUMNS

FLOW_COLUMNS = (
    "start_time, dur, proto, src_addr, sport, dir, dst_addr, dport, state, s_tos, d_tos, "
    "tot_pkts, tot_bytes, src_bytes, label"
)


TEXTS = ", ".join(f"'{name}'" for name, kind in ATTRIBUTES if kind == "text")


def _hash_number(name: str, *key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '0', '{name}', {', '.join(key)})), 1, 15) AS BIGINT)"


def _upper(number: str) -> str:
    return f"((({number} >> 30) + 1) / 1073741824.0::DOUBLE)"


def _lower(number: str) -> str:
    return f"((({number} & 1073741823) + 1) / 1073741824.0::DOUBLE)"


def _uniform(name: str, *key: str) -> str:
    return _upper(_hash_number(name, *key))


def _numeric(name: str, kind: str) -> str:
    if kind == "time":
        return f"CAST(epoch(date_trunc('second', {name})) AS DOUBLE)"
    if kind == "text":
        return "CAST(NULL AS DOUBLE)"
    if kind == "port":
        digits = f"ltrim(substr({name}, 3), '0')"
        value = f"CASE WHEN {digits} = '' THEN 0 WHEN length({digits}) <= 15 THEN CAST(TRY_CAST('0x' || {digits} AS BIGINT) AS DOUBLE) END"
        return f"CASE WHEN {name} LIKE '0x%' THEN {value} ELSE TRY_CAST({name} AS DOUBLE) END"
    return f"TRY_CAST({name} AS DOUBLE)"


def _attributes(table: str, scenario: bool) -> str:
    extra = "scenario, " if scenario else ""
    return " UNION ALL ".join(
        f"SELECT {extra}'{name}' AS attribute, CAST({name} AS VARCHAR) AS label, {_numeric(name, kind)} AS val FROM {table}"
        for name, kind in ATTRIBUTES
    )


def _features(edges: str, tag: str, k: str) -> dict[str, str]:
    """CTEs for the features of the graph in ``edges``; ``k`` is a prefix of key columns ('' or 'scenario, ')."""

    def on(a: str, b: str) -> str:
        return f" AND {a}.scenario = {b}.scenario" if k else ""

    ak = "a.scenario, " if k else ""
    e = edges
    return {
        f"ends{tag}": f"SELECT {k}src AS id, dst AS nbr, 0 AS i, 1 AS o FROM {e} UNION ALL SELECT {k}dst, src, 1, 0 FROM {e}",
        f"deg{tag}": f"SELECT {k}id, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree, count(*) AS degree FROM ends{tag} GROUP BY ALL",
        f"nbrdeg{tag}": f"SELECT {ak}a.id, avg(b.degree) AS d FROM ends{tag} a JOIN deg{tag} b ON a.nbr = b.id{on('a', 'b')} GROUP BY ALL",
        f"nb{tag}": f"SELECT DISTINCT {k}id, nbr FROM ends{tag} WHERE id <> nbr",
        f"nbn{tag}": f"SELECT {k}id, count(*) AS n FROM nb{tag} GROUP BY ALL",
        # directed edges among the neighbours, straight from the definition
        f"inner_t{tag}": f"SELECT {ak}a.id, count(*) AS l, count(DISTINCT least(x.src, x.dst) || '|' || greatest(x.src, x.dst)) AS t"
        f" FROM nb{tag} a JOIN {e} x ON a.nbr = x.src{on('a', 'x')} JOIN nb{tag} b ON b.id = a.id AND b.nbr = x.dst{on('a', 'b')}"
        " WHERE x.src <> x.dst GROUP BY ALL",
    }


def _k_core(edges: str, k: str) -> str:
    """Message passing: one row per step and node; a step without messages moves on to the next k."""
    on_s = " AND s.scenario = e.scenario" if k else ""
    on_d = " AND d.scenario = e.scenario" if k else ""
    ek = "e.scenario, " if k else ""
    sk = "st.scenario, " if k else ""
    using = "scenario, id" if k else "id"
    return f"""
    SELECT 0 AS rnd, 1 AS k, {k}id, degree AS val, true AS act FROM deg{'_s' if k else ''}
    UNION ALL
    (WITH m AS (SELECT {ek}e.src, e.dst, s.val AS sv, d.val AS dv, s.k
                FROM {edges} e JOIN st s ON s.id = e.src{on_s} JOIN st d ON d.id = e.dst{on_d}
                WHERE s.act AND d.act AND (s.val < s.k OR d.val < s.k)),
          msg AS (SELECT {k}src AS id, CASE WHEN sv < k THEN 0 ELSE 1 END AS dec, sv >= k AS keep FROM m
                  UNION ALL
                  SELECT {k}dst, CASE WHEN dv < k THEN 0 ELSE 1 END, dv >= k FROM m),
          agg AS (SELECT {k}id, sum(dec) AS dec, bool_and(keep) AS keep FROM msg GROUP BY ALL),
          cnt AS (SELECT count(*) AS c FROM agg)
     SELECT rnd + 1, CASE WHEN c = 0 THEN st.k + 1 ELSE st.k END, {sk}st.id,
            CAST(CASE WHEN c = 0 THEN CASE WHEN act THEN greatest(st.k, val) ELSE val END
                      WHEN act AND agg.id IS NOT NULL THEN greatest(st.k - 1, val - dec) ELSE val END AS BIGINT),
            CASE WHEN c > 0 AND act AND agg.id IS NOT NULL THEN keep ELSE act END
     FROM st CROSS JOIN cnt LEFT JOIN agg USING ({using})
     WHERE NOT (c = 0 AND st.k = 3))"""


def _params(flows: str, tag: str, k: str) -> dict[str, str]:
    def on(a: str, b: str) -> str:
        return f" AND {a}.scenario = {b}.scenario" if k else ""

    ak, rk, wk = ("a.scenario, ", "r.scenario, ", "scenario, ") if k else ("", "", "")
    scen = f"(SELECT DISTINCT scenario FROM {flows})" if k else "(SELECT 1 AS one)"
    part = "PARTITION BY scenario" if k else ""

    def lower(b: str, w: str) -> str:
        return f"CASE WHEN {b} < 20 THEN {b} ELSE 20 + ({b} - 20) * {w} END"

    def bin_(d: str, w: str) -> str:
        return f"CASE WHEN {d} < 20 THEN {d} ELSE 20 + ({d} - 20) // {w} END"

    def width(d: str) -> str:
        return f"greatest(1, CAST(ceil((max({d}) + 1 - 20) / 180.0::DOUBLE) AS BIGINT))"

    return {
        f"fends{tag}": f"SELECT {k}src_addr AS id, 0 AS i, 1 AS o FROM {flows} UNION ALL SELECT {k}dst_addr, 1, 0 FROM {flows}",
        f"fdeg{tag}": f"SELECT {k}id, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree, count(*) AS degree FROM fends{tag} GROUP BY ALL",
        f"roles{tag}": f"SELECT {k}id AS node, CAST(CAST(id AS BIGINT) % {N_ROLES} AS INT) AS role FROM fdeg{tag}",
        f"rdeg{tag}": f"SELECT {ak}a.id, r.role, a.indegree, a.outdegree FROM fdeg{tag} a JOIN roles{tag} r ON a.id = r.node{on('a', 'r')}",
        f"sizes{tag}": f"SELECT {rk.replace('r.', 's.')}g.role, count(r.node) AS n_nodes FROM {scen} s CROSS JOIN (SELECT CAST(unnest(range({N_ROLES})) AS INT) AS role) g"
        f" LEFT JOIN roles{tag} r ON r.role = g.role{on('r', 's')} GROUP BY ALL",
        f"redges{tag}": f"SELECT {rk.replace('r.', 's.')}g.role AS src_role, h.role AS dst_role, count(f.src_addr) AS n FROM {scen} s"
        f" CROSS JOIN (SELECT CAST(unnest(range({N_ROLES})) AS INT) AS role) g CROSS JOIN (SELECT CAST(unnest(range({N_ROLES})) AS INT) AS role) h"
        f" LEFT JOIN {flows} f ON CAST(f.src_addr AS BIGINT) % {N_ROLES} = g.role AND CAST(f.dst_addr AS BIGINT) % {N_ROLES} = h.role{on('f', 's')} GROUP BY ALL",
        f"rprob{tag}": f"SELECT {k}src_role, dst_role, n, coalesce(n / nullif(sum(n) OVER (PARTITION BY {wk}src_role), 0), 0) AS p_trans,"
        f" coalesce(n / nullif(sum(n) OVER ({part}), 0), 0) AS p_joint FROM redges{tag}",
        f"widths{tag}": f"SELECT {k}role, {width('indegree')} AS iw, {width('outdegree')} AS ow FROM rdeg{tag} GROUP BY ALL",
        f"cells{tag}": f"SELECT {ak}a.role, {bin_('a.indegree', 'w.iw')} AS ib, {bin_('a.outdegree', 'w.ow')} AS ob, w.iw, w.ow, count(*) AS n"
        f" FROM rdeg{tag} a JOIN widths{tag} w ON a.role = w.role{on('a', 'w')} GROUP BY ALL",
        f"hist{tag}": f"SELECT {k}role, {lower('ib', 'iw')} AS in_lo, {lower('(ib + 1)', 'iw')} AS in_hi, {lower('ob', 'ow')} AS out_lo,"
        f" {lower('(ob + 1)', 'ow')} AS out_hi, n FROM cells{tag}",
        f"hist_dense{tag}": f"SELECT w.role, {lower('g.b', 'iw')} AS in_lo, {lower('(g.b + 1)', 'iw')} AS in_hi, {lower('h.b', 'ow')} AS out_lo,"
        f" {lower('(h.b + 1)', 'ow')} AS out_hi, coalesce(c.n, 0) AS n FROM widths{tag} w CROSS JOIN (SELECT unnest(range(200)) AS b) g"
        f" CROSS JOIN (SELECT unnest(range(200)) AS b) h"
        f" LEFT JOIN (SELECT role, ib, ob, n FROM cells{tag}) c ON c.role = w.role AND c.ib = g.b AND c.ob = h.b",
        f"bins{tag}": f"SELECT role, d.direction, g.b AS bin, {lower('g.b', 'd.w')} AS lo, {lower('(g.b + 1)', 'd.w')} AS hi"
        f" FROM (SELECT role, 'in' AS direction, iw AS w FROM widths{tag} UNION ALL SELECT role, 'out', ow FROM widths{tag}) d"
        " CROSS JOIN (SELECT unnest(range(200)) AS b) g",
    }


def _histograms(attrs: str, tag: str, k: str) -> dict[str, str]:
    """Equal-frequency edges from the sorted rows themselves; counts by comparing values with the edges."""

    def on(a: str, b: str) -> str:
        return f" AND {a}.scenario = {b}.scenario" if k else ""

    ak = "a.scenario, " if k else ""
    pk = "p.scenario, " if k else ""
    ek = "e.scenario, " if k else ""
    return {
        f"asum{tag}": f"SELECT {k}attribute, count(*) AS n_rows, count(label) AS n_present, count(DISTINCT label) AS n_distinct FROM {attrs} GROUP BY ALL",
        f"cat{tag}": f"SELECT {ak}a.attribute, a.label, count(*) AS n, s.n_rows AS total FROM {attrs} a JOIN asum{tag} s ON a.attribute = s.attribute{on('a', 's')}"
        f" WHERE (s.n_distinct <= 100 OR a.attribute IN ({TEXTS})) AND a.label IS NOT NULL GROUP BY ALL",
        f"catb{tag}": f"SELECT {k}attribute, CAST(row_number() OVER (PARTITION BY {k}attribute ORDER BY n DESC, label) AS INT) AS bin, label, n, total FROM cat{tag}",
        f"srt{tag}": f"SELECT {ak}a.attribute, a.val, row_number() OVER (PARTITION BY {ak}a.attribute ORDER BY a.val) - 1 AS r, count(*) OVER (PARTITION BY {ak}a.attribute) AS total"
        f" FROM {attrs} a JOIN asum{tag} s ON a.attribute = s.attribute{on('a', 's')} WHERE s.n_distinct > 100 AND a.attribute NOT IN ({TEXTS}) AND a.val IS NOT NULL",
        f"pts{tag}": f"SELECT t.*, q, k, ((total - 1) * k) // q AS r, (((total - 1) * k) % q) / q AS part FROM (SELECT DISTINCT {k}attribute, total FROM srt{tag}) t"
        " CROSS JOIN (SELECT unnest(range(1, 101)) AS q) CROSS JOIN (SELECT unnest(range(0, 101)) AS k) WHERE k <= q",
        f"edg{tag}": f"SELECT {pk}p.attribute, p.total, p.q, p.k, CASE WHEN p.part > 0 THEN lo.val + (hi.val - lo.val) * p.part ELSE lo.val END AS edge"
        f" FROM pts{tag} p JOIN srt{tag} lo ON lo.attribute = p.attribute AND lo.r = p.r{on('lo', 'p')}"
        f" LEFT JOIN srt{tag} hi ON hi.attribute = p.attribute AND hi.r = p.r + 1{on('hi', 'p')}",
        f"best{tag}": f"SELECT {k}attribute, max(q) AS q FROM (SELECT {k}attribute, q FROM edg{tag} GROUP BY ALL HAVING count(DISTINCT edge) = q + 1 OR q = 1) GROUP BY ALL",
        f"iv{tag}": f"SELECT {ek}e.attribute, e.total, e.k AS bin, lag(e.edge) OVER (PARTITION BY {ek}e.attribute ORDER BY e.k) AS lo, e.edge AS hi"
        f" FROM edg{tag} e JOIN best{tag} b ON b.attribute = e.attribute AND b.q = e.q{on('b', 'e')}",
        f"qnt{tag}": f"SELECT {ek}e.attribute, CAST(e.bin AS INT) AS bin, e.lo, e.hi, count(*) AS n, e.total FROM iv{tag} e JOIN srt{tag} a ON a.attribute = e.attribute{on('a', 'e')}"
        " AND a.val <= e.hi AND (a.val > e.lo OR (e.bin = 1 AND a.val >= e.lo)) WHERE e.bin >= 1 GROUP BY ALL",
        f"allh{tag}": f"SELECT {k}attribute, bin, label, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, n, total, n / total AS p FROM catb{tag}"
        f" UNION ALL SELECT {k}attribute, bin, CAST(NULL AS VARCHAR), lo, hi, n, total, n / total FROM qnt{tag}",
        f"cum{tag}": f"SELECT *, (sum(n) OVER w - n) / total AS cum_lo, sum(n) OVER w / total AS cum_hi FROM allh{tag} WINDOW w AS (PARTITION BY {k}attribute ORDER BY bin)",
    }


def _intersection(first: str, second: str, k: str) -> dict[str, str]:
    def on(a: str, b: str) -> str:
        return f" AND {a}.scenario = {b}.scenario" if k else ""

    bk = "b.scenario, " if k else ""
    return {
        "both_": f"SELECT {k}property, val, 1 AS h1, 0 AS h2 FROM ({first}) UNION ALL SELECT {k}property, val, 0, 1 FROM ({second})",
        "scope_": f"SELECT {k}property, min(val) AS lo, max(val) AS hi, least(sum(h1), sum(h2)) // 2 AS nb FROM both_ GROUP BY ALL",
        "ewh": f"SELECT {bk}b.property, CAST(CASE WHEN hi > lo THEN least(floor((val - lo) * nb / (hi - lo)), nb - 1) ELSE 0 END AS BIGINT) AS bin,"
        f" CAST(sum(h1) AS BIGINT) AS h1, CAST(sum(h2) AS BIGINT) AS h2 FROM both_ b JOIN scope_ s ON s.property = b.property{on('s', 'b')} WHERE nb > 0 GROUP BY ALL",
        "score_": f"SELECT {k}property, round(sum(least(h1, h2)) / sum(h2), 9) AS score FROM ewh GROUP BY ALL",
        "report_": f"SELECT {bk}b.property, s.score FROM (SELECT DISTINCT {k}property FROM both_) b LEFT JOIN score_ s ON s.property = b.property{on('s', 'b')}",
    }


def _binned(table: str) -> str:
    """Values with seven decimals, or with as many more as the narrow bins of their property call for."""
    return f"SELECT property, CASE WHEN digits > 7 THEN round(val * pow(10.0, digits)) / pow(10.0, digits) ELSE round(val, 7) END AS val FROM {table} JOIN digits7 USING (property)"


def _degree_rows(flows: str, k: str, total: bool) -> str:
    """(property, val) of the flow degrees of every host of a flow table."""
    degree = "UNPIVOT (SELECT {k}id, CAST(sum(i) AS DOUBLE) AS indegree, CAST(sum(o) AS DOUBLE) AS outdegree{t} FROM (" \
        "SELECT {k}src_addr AS id, 0 AS i, 1 AS o FROM {f} UNION ALL SELECT {k}dst_addr, 1, 0 FROM {f}) GROUP BY ALL)" \
        " ON {c} INTO NAME property VALUE val"
    columns = "indegree, outdegree" + (", degree" if total else "")
    return f"SELECT {k}property, val FROM ({degree.format(k=k, f=flows, t=', CAST(count(*) AS DOUBLE) AS degree' if total else '', c=columns)})"


def _draws() -> tuple[str, str, str]:
    """Numbers, joins and columns that draw every attribute of a synthetic flow."""
    drawn = {"proto", *[name for _, name in SYNTH_COLUMNS]}
    numbers, joins, columns = "", "", []
    for n, (name, kind) in enumerate([a for a in ATTRIBUTES if a[0] in drawn]):
        numbers += f", {_hash_number(name, 'src', 'stub')} AS z{n}"
        u = _upper(f"e.z{n}")
        joins += f" LEFT JOIN (SELECT * FROM cum WHERE attribute = '{name}') h{n} ON {u} > h{n}.cum_lo AND {u} <= h{n}.cum_hi"
        if kind == "text":
            columns.append(f"h{n}.label AS {name}")
        else:
            inside = f"h{n}.lo + {_lower(f'e.z{n}')} * (h{n}.hi - h{n}.lo)"
            text = f"CAST(h{n}.label AS TIMESTAMP)" if kind == "time" else f"h{n}.label"
            columns.append(f"round(coalesce({inside}, {_numeric(text, kind)}), 3) AS {name}")
    return numbers, joins, ", ".join(columns)


def _lloyd(tag: str, k: str, rounds: int = 10) -> dict[str, str]:
    """Centres that start at the first hosts in hash order and move, round by round."""
    part = "PARTITION BY scenario " if k else ""
    names = ", ".join(FEATURES)
    first = f"row_number() OVER ({part}ORDER BY {_hash_number('start', 'id')}, id) - 1"
    on = "AND x.scenario = c.scenario" if k else ""
    xk = "x.scenario, " if k else ""
    using = "(scenario, role)" if k else "(role)"
    rounded = ", ".join(f"round({c}, 9) AS {c}" for c in FEATURES)
    far = " + ".join(f"pow(x.{c} - c.{c}, 2)" for c in FEATURES)
    out = {f"km{tag}0": f"SELECT {k}role, {rounded} FROM (SELECT *, {first} AS role FROM scaled{tag}) WHERE role < {N_ROLES}"}

    def assigned(n: int) -> str:
        return f"SELECT {xk}x.id, arg_min(c.role, ({far}, c.role)) AS role FROM scaled{tag} x JOIN km{tag}{n} c ON true {on} GROUP BY ALL"

    for n in range(1, rounds + 1):
        ids = "(scenario, id)" if k else "(id)"
        means = ", ".join(f"round(avg(x.{c}), 9) AS {c}" for c in FEATURES)
        out[f"ka{tag}{n}"] = assigned(n - 1)
        out[f"kn{tag}{n}"] = f"SELECT {k}role, {means} FROM ka{tag}{n} JOIN scaled{tag} x USING {ids} GROUP BY ALL"
        kept = ", ".join(f"coalesce(b.{c}, a.{c}) AS {c}" for c in FEATURES)
        out[f"km{tag}{n}"] = f"SELECT {k}role, {kept} FROM km{tag}{n - 1} a LEFT JOIN kn{tag}{n} b USING {using}"
    out[f"kc{tag}"] = f"SELECT * REPLACE (row_number() OVER ({part}ORDER BY {names}, role) - 1 AS role) FROM km{tag}{rounds}"
    out[f"kr{tag}"] = assigned(0).replace(f"km{tag}0", f"kc{tag}")
    return out


def _renamed(ctes: dict[str, str], names: list[str], to: dict[str, str], tag: str) -> dict[str, str]:
    """Copies of some tables under names with a tag, reading others that ``to`` names."""
    every = {name: name + tag for name in names} | to
    swap = lambda text: re.sub(r"[A-Za-z_0-9]+", lambda m: every.get(m[0], m[0]), text)
    return {every[name]: swap(ctes[name]) for name in names}


def _ctes() -> dict[str, str]:
    numbers, joins, columns = _draws()
    point = ", ".join(f"(x.{c} - m.avg_{c}) / CASE WHEN m.std_{c} = 0 THEN 1 ELSE m.std_{c} END AS {c}" for c in FEATURES)
    ctes = {
        "flows": FLOW_VIEW.format(extra="", table="lineitem"),
        "flows_s": FLOW_VIEW.format(extra=", l_returnflag AS scenario", table="lineitem"),
        "edges": "SELECT DISTINCT src_addr AS src, dst_addr AS dst FROM flows",
        "edges_s": "SELECT DISTINCT scenario, src_addr AS src, dst_addr AS dst FROM flows_s",
        **_features("edges", "", ""),
        **_features("edges_s", "_s", "scenario, "),
        "features": """
            SELECT d.id, d.indegree, d.outdegree, a.d AS average_neighbor_degree,
                   coalesce(i.t, 0) AS triangles, coalesce(2 * i.l / (n.n * (n.n - 1)), 0) AS clustering_coefficient,
                   CAST(c.kcore AS INT) AS "kCore"
            FROM deg d JOIN nbrdeg a USING (id) LEFT JOIN nbn n USING (id) LEFT JOIN inner_t i USING (id) JOIN kcore_t c USING (id)
        """,
        "means": "SELECT " + ", ".join(f'avg("{c}") AS avg_{c}, stddev_pop("{c}") AS std_{c}' for c in FEATURES) + " FROM features",
        "scaled": f"SELECT x.id, {point} FROM features x CROSS JOIN means m",
        "bots": "SELECT DISTINCT src_addr AS id FROM flows WHERE contains(label, 'Botnet')",
        "profile": "SELECT count(*) AS n_bots, CAST(min(indegree) AS BIGINT) AS in_min, CAST(max(indegree) AS BIGINT) AS in_max,"
        " CAST(min(outdegree) AS BIGINT) AS out_min, CAST(max(outdegree) AS BIGINT) AS out_max, "
        + ", ".join(f'avg("{c}") AS mean_{c}' for c in FEATURES)
        + " FROM bots LEFT JOIN features USING (id)",
        "centres": "SELECT * FROM (VALUES "
        + ", ".join(f"({n}, " + ", ".join(f"{x}::DOUBLE" for x in c) + ")" for n, c in enumerate(CENTROIDS))
        + ") c(role, " + ", ".join("c_" + c for c in FEATURES) + ")",
        **_params("flows", "", ""),
        **_params("flows_s", "_s", "scenario, "),
        "attrs": _attributes("flows", False),
        "attrs_s": _attributes("flows_s", True),
        **_histograms("attrs", "", ""),
        **_histograms("attrs_s", "_s", "scenario, "),
        "fprofile": "SELECT 1 AS role, count(*) AS n_bots, min(indegree) AS in_min, max(indegree) AS in_max, min(outdegree) AS out_min,"
        " max(outdegree) AS out_max FROM bots JOIN fdeg USING (id)",
        "cell_rows": "SELECT h.*, CAST(unnest(range(n)) AS BIGINT) AS i, coalesce(sum(n) OVER (ORDER BY role, in_lo, out_lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM hist h",
        "hosts": f"""
            SELECT id, role, least(CAST(floor(in_lo + {_uniform('in', 'id')} * (in_hi - in_lo)) AS BIGINT), in_hi - 1) AS indegree,
                   least(CAST(floor(out_lo + {_uniform('out', 'id')} * (out_hi - out_lo)) AS BIGINT), out_hi - 1) AS outdegree
            FROM (SELECT *, CAST(off + i AS BIGINT) AS id FROM cell_rows)""",
        "cell_rows_s": "SELECT h.*, CAST(unnest(range(n)) AS BIGINT) AS i, coalesce(sum(n) OVER (ORDER BY scenario, role, in_lo, out_lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM hist_s h",
        "hosts_s": f"""
            SELECT scenario, id, role, least(CAST(floor(in_lo + {_uniform('in', 'id')} * (in_hi - in_lo)) AS BIGINT), in_hi - 1) AS indegree,
                   least(CAST(floor(out_lo + {_uniform('out', 'id')} * (out_hi - out_lo)) AS BIGINT), out_hi - 1) AS outdegree
            FROM (SELECT *, CAST(1000 + off + i AS BIGINT) AS id FROM cell_rows_s)""",
        "supply": "SELECT role, count(*) AS n_nodes, CAST(sum(indegree) AS BIGINT) AS in_stubs, CAST(sum(outdegree) AS BIGINT) AS out_stubs,"
        " sum(indegree) <= sum(outdegree) AS short FROM hosts GROUP BY role",
        "cdf": """
            SELECT src_role, dst_role, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY src_role) AS lo, sum(n) OVER w / sum(n) OVER (PARTITION BY src_role) AS hi
            FROM redges WHERE n > 0 AND dst_role IN (SELECT role FROM supply WHERE in_stubs > 0) WINDOW w AS (PARTITION BY src_role ORDER BY dst_role)""",
        "raw_stubs": "SELECT id, role AS src_role, CAST(unnest(range(outdegree)) AS BIGINT) AS stub FROM hosts",
        "stubs": f"SELECT s.id, s.stub, s.src_role, c.dst_role FROM (SELECT *, {_uniform('role', 'id', 'stub')} AS u FROM raw_stubs) s"
        " JOIN cdf c ON c.src_role = s.src_role AND s.u > c.lo AND s.u <= c.hi",
        # every in-stub written out and numbered, out-stubs dealt to them in hash order
        "in_stubs_": "SELECT dst_role, dst, row_number() OVER (PARTITION BY dst_role ORDER BY dst) - 1 AS slot"
        " FROM (SELECT role AS dst_role, id AS dst, unnest(range(indegree)) AS j FROM hosts)",
        "ranked_": f"SELECT *, row_number() OVER (PARTITION BY dst_role ORDER BY {_hash_number('pair', 'id', 'stub')}, id, stub) - 1 AS rnk FROM stubs",
        "sedges": """
            SELECT r.id AS src, r.stub, i.dst, r.src_role, r.dst_role
            FROM ranked_ r JOIN supply s ON s.role = r.dst_role JOIN in_stubs_ i ON i.dst_role = r.dst_role AND i.slot = r.rnk % s.in_stubs
            WHERE r.id <> i.dst""",
        "candidates": f"""
            SELECT id FROM (SELECT h.id, p.n_bots, row_number() OVER (ORDER BY {_hash_number('bot', 'h.id')}, h.id) AS rn
            FROM hosts h JOIN fprofile p ON h.role = p.role AND h.indegree BETWEEN p.in_min AND p.in_max AND h.outdegree BETWEEN p.out_min AND p.out_max) WHERE rn <= n_bots""",
        "drawn": f"SELECT *{numbers} FROM sedges",
        "sattrs": f"SELECT e.src, e.stub, e.dst, e.src_role, e.dst_role, {columns} FROM drawn e{joins}",
        "dirty": DIRTY_VIEW.format(table="lineitem"),
        "attrs_d": _attributes("dirty", False),
        **_histograms("attrs_d", "_d", ""),
        "redges_d": "SELECT a.r AS src_role, b.r AS dst_role, count(f.src_addr) AS n FROM (SELECT CAST(unnest(range(6)) AS INT) AS r) a"
        " CROSS JOIN (SELECT CAST(unnest(range(6)) AS INT) AS r) b LEFT JOIN dirty f ON CAST(f.src_addr AS BIGINT) % 6 = a.r AND CAST(f.dst_addr AS BIGINT) % 6 = b.r GROUP BY ALL",
        "fends_d": "SELECT src_addr AS id, 0 AS i, 1 AS o FROM dirty UNION ALL SELECT dst_addr, 1, 0 FROM dirty",
        "features_s": """
            SELECT d.scenario, d.id, d.indegree, d.outdegree, a.d AS average_neighbor_degree, coalesce(i.t, 0) AS triangles,
                   coalesce(2 * i.l / (n.n * (n.n - 1)), 0) AS clustering_coefficient, CAST(c.kcore AS INT) AS "kCore"
            FROM deg_s d JOIN nbrdeg_s a USING (scenario, id) LEFT JOIN nbn_s n USING (scenario, id)
                 LEFT JOIN inner_t_s i USING (scenario, id) JOIN kcore_ts c USING (scenario, id)""",
        "means_s": "SELECT scenario, " + ", ".join(f'avg("{c}") AS avg_{c}, stddev_pop("{c}") AS std_{c}' for c in FEATURES) + " FROM features_s GROUP BY scenario",
        "scaled_s": f"SELECT x.scenario, x.id, {point} FROM features_s x JOIN means_s m USING (scenario)",
        **_lloyd("", ""),
        **_lloyd("_s", "scenario, "),
        "bots_s": "SELECT DISTINCT scenario, src_addr AS id FROM flows_s WHERE contains(label, 'Botnet')",
        "profile_s": "SELECT scenario, count(b.id) AS n_bots, "
        + ", ".join(f'avg("{c}") AS mean_{c}' for c in FEATURES)
        + " FROM (SELECT DISTINCT scenario FROM flows_s) s LEFT JOIN bots_s b USING (scenario) LEFT JOIN features_s f USING (scenario, id) GROUP BY scenario",
        "half1": "SELECT * FROM flows WHERE dir = '->'",
        "half2": "SELECT * FROM flows WHERE dir = '<->'",
        "half1_s": "SELECT * FROM flows_s WHERE dir = '->'",
        "half2_s": "SELECT * FROM flows_s WHERE dir = '<->'",
    }
    return ctes


def _needed(final: str, ctes: dict[str, str]) -> list[str]:
    found: set[str] = set()
    todo = [final]
    while todo:
        words = set(re.findall(r"[A-Za-z_0-9]+", todo.pop()))
        fresh = (words & set(ctes)) - found
        found |= fresh
        todo += [ctes[name] for name in fresh]
    return [name for name in _sorted(found, ctes)]


def _sorted(names: set[str], ctes: dict[str, str]) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in set(re.findall(r"[A-Za-z_0-9]+", ctes[name])) & names - {name}:
            visit(other)
        done.append(name)

    for name in sorted(names):
        visit(name)
    return done


def _query(final: str, ctes: dict[str, str]) -> str:
    names = _needed(final, ctes)
    if not names:
        return final
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in names) else ""
    parts = []
    for name in names:
        head = f"{name}{RECURSIVE.get(name, '')} AS " + ("" if name in RECURSIVE else "MATERIALIZED ")
        parts.append(f"{head}({ctes[name]})")
    return f"WITH {recursive}" + ",\n".join(parts) + f"\n{final}"


# recursive tables with their column lists
RECURSIVE = {
    "st": "(rnd, k, id, val, act)",
    "st_s": "(rnd, k, scenario, id, val, act)",
    "hidx": "(rnd, id, est, chg)",
    "pr": "(rnd, id, x, err)",
    **{f"hidx_h{n}": "(rnd, id, est, chg)" for n in (1, 2)},
    **{f"pr_h{n}": "(rnd, id, x, err)" for n in (1, 2)},
}


def oracle_sql() -> dict[str, str]:
    ctes = _ctes()
    ctes["st"] = _k_core("edges", "")
    ctes["st_s"] = _k_core("edges_s", "scenario, ").replace(" st ", " st_s ").replace("st.", "st_s.")
    ctes["kcore_t"] = "SELECT id, val AS kcore FROM st WHERE rnd = (SELECT max(rnd) FROM st)"
    ctes["kcore_ts"] = "SELECT scenario, id, val AS kcore FROM st_s WHERE rnd = (SELECT max(rnd) FROM st_s)"
    # h-index by ranking the neighbours' values
    ctes["hidx"] = """
        SELECT 0 AS rnd, id, n AS est, true AS chg FROM nbn
        UNION ALL
        SELECT rnd + 1, id, h, bool_or(h <> est) OVER () FROM (
            SELECT any_value(rnd) AS rnd, id, any_value(own) AS est, count(*) FILTER (v >= rn) AS h FROM (
                SELECT a.rnd, a.id, a.est AS own, b.est AS v, row_number() OVER (PARTITION BY a.id ORDER BY b.est DESC) AS rn
                FROM hidx a JOIN nb ON nb.id = a.id JOIN hidx b ON b.id = nb.nbr WHERE a.chg) GROUP BY id)"""
    ctes["core_t"] = (
        "SELECT d.id, CAST(coalesce(h.est, 0) AS INT) AS core FROM deg d"
        " LEFT JOIN (SELECT id, est FROM hidx WHERE rnd = (SELECT max(rnd) FROM hidx)) h USING (id)"
    )
    ctes["sym"] = "SELECT DISTINCT id, nbr FROM ends"
    ctes["symdeg"] = "SELECT id, count(*) AS n, count(*) OVER () AS total FROM sym GROUP BY id"
    ctes["pr"] = """
        SELECT 0 AS rnd, id, 1.0::DOUBLE / total AS x, 1.0::DOUBLE AS err FROM symdeg
        UNION ALL
        SELECT rnd, id, x, sum(abs(x - old)) OVER () / count(*) OVER () FROM (
            SELECT p.rnd + 1 AS rnd, p.id, any_value(p.x) AS old, 0.15 / any_value(d.total) + 0.85 * sum(q.x / dq.n) AS x
            FROM pr p JOIN symdeg d ON d.id = p.id JOIN sym s ON s.id = p.id JOIN pr q ON q.id = s.nbr JOIN symdeg dq ON dq.id = q.id
            WHERE p.err >= 1e-6 AND p.rnd < 100 GROUP BY p.rnd, p.id)"""
    ctes["x0"] = "SELECT id, outdegree, 0.15::DOUBLE AS x FROM deg"
    for n in range(1, 6):
        ctes[f"x{n}"] = (
            f"SELECT d.id, any_value(d.outdegree) AS outdegree, 0.15 + 0.85 * coalesce(sum(p.x / p.outdegree), 0) AS x"
            f" FROM deg d LEFT JOIN edges e ON e.dst = d.id LEFT JOIN x{n - 1} p ON p.id = e.src GROUP BY d.id"
        )
    # shortest-path pairs hop by hop, for sources that have not reached everything
    for tag, step in (("u", "SELECT id AS a, nbr AS b FROM nb"), ("d", "SELECT src AS a, dst AS b FROM edges WHERE src <> dst")):
        ctes[f"hop{tag}"] = step
        ctes[f"{tag}0"] = "SELECT id AS s, id AS t, 0 AS d, 1.0::DOUBLE AS w FROM deg"
        for n in range(1, 7):
            ctes[f"{tag}{n}"] = f"""
                SELECT * FROM {tag}{n - 1}
                UNION ALL
                SELECT f.s, h.b, {n}, sum(f.w) FROM {tag}{n - 1} f JOIN hop{tag} h ON h.a = f.t
                WHERE f.d = {n - 1} AND f.s IN (SELECT s FROM {tag}{n - 1} GROUP BY s HAVING count(*) < (SELECT count(*) FROM deg))
                  AND NOT EXISTS (SELECT 1 FROM {tag}{n - 1} v WHERE v.s = f.s AND v.t = h.b)
                GROUP BY ALL"""
    ctes["bt"] = """
        SELECT v.s AS id, sum(a.w * b.w / p.w) AS c FROM (SELECT id AS s FROM deg) v
        JOIN d6 a ON a.t = v.s AND a.s <> v.s JOIN d6 b ON b.s = v.s AND b.t <> v.s
        JOIN d6 p ON p.s = a.s AND p.t = b.t AND p.d = a.d + b.d AND p.s <> p.t GROUP BY v.s"""
    ctes["pivots"] = f"SELECT id FROM deg ORDER BY {_hash_number('pivot', 'id')}, id LIMIT 64"
    ctes["btp"] = ctes["bt"].replace("GROUP BY v.s", "WHERE a.s IN (SELECT id FROM pivots) GROUP BY v.s")
    ctes["canon1"] = "SELECT DISTINCT src_addr AS src, dst_addr AS dst FROM half1"
    ctes["canon2"] = "SELECT DISTINCT src_addr AS src, dst_addr AS dst FROM half2"
    for tag in ("1", "2"):
        ctes.update(_features(f"canon{tag}", f"_h{tag}", ""))
        ctes[f"prop{tag}"] = (
            _degree_rows(f"half{tag}", "", True)
            + f" UNION ALL SELECT 'average_neighbor_degree', d FROM nbrdeg_h{tag}"
            + f" UNION ALL SELECT 'triangles', coalesce(i.t, 0) FROM deg_h{tag} d LEFT JOIN inner_t_h{tag} i USING (id)"
            + f" UNION ALL SELECT 'clustering_undirected', coalesce(2 * i.t / (n.n * (n.n - 1)), 0)"
            + f" FROM deg_h{tag} d LEFT JOIN nbn_h{tag} n USING (id) LEFT JOIN inner_t_h{tag} i USING (id)"
        )
    for tag in ("1", "2"):
        to = {"edges": f"canon{tag}", "flows": f"half{tag}"} | {n: f"{n}_h{tag}" for n in ("ends", "deg", "nb", "nbn", "inner_t")}
        ctes.update(_renamed(ctes, ["fends", "fdeg", "sym", "symdeg", "pr", "hidx", "core_t"], to, f"_h{tag}"))
        ctes[f"seven{tag}"] = (
            _degree_rows(f"half{tag}", "", False)
            + f" UNION ALL SELECT 'avg_successor_degree', coalesce(sum(t.outdegree), 0) / greatest(any_value(d.outdegree), 1)"
            f" FROM fdeg_h{tag} d LEFT JOIN canon{tag} e ON e.src = d.id LEFT JOIN fdeg_h{tag} t ON t.id = e.dst GROUP BY d.id"
            f" UNION ALL SELECT 'pagerank', x FROM pr_h{tag} WHERE rnd = (SELECT max(rnd) FROM pr_h{tag})"
            f" UNION ALL SELECT 'triangles', coalesce(i.t, 0) FROM deg_h{tag} d LEFT JOIN inner_t_h{tag} i USING (id)"
            f" UNION ALL SELECT 'clustering_undirected', coalesce(2 * i.t / (n.n * (n.n - 1)), 0)"
            f" FROM deg_h{tag} d LEFT JOIN nbn_h{tag} n USING (id) LEFT JOIN inner_t_h{tag} i USING (id)"
            f" UNION ALL SELECT 'core', core FROM core_t_h{tag}"
        )
    ctes["ends7"] = (
        "SELECT property, min(val) AS lo, max(val) AS hi, least(sum(h1), sum(h2)) AS n"
        " FROM (SELECT property, val, 1 AS h1, 0 AS h2 FROM seven1 UNION ALL SELECT property, val, 0, 1 FROM seven2) GROUP BY property"
    )
    ctes["digits7"] = (
        "SELECT property, CASE WHEN w > 0 AND w < 1e-6 THEN greatest(7, least(3 - floor(log10(w)), 12 - ceil(log10(greatest(abs(lo), abs(hi)))))) ELSE 7 END AS digits"
        " FROM (SELECT *, (hi - lo) / greatest(n // 2, 1) AS w FROM ends7)"
    )
    features_s = """
        SELECT d.scenario, d.id, d.indegree, d.outdegree,
               round(a.d, 9) AS average_neighbor_degree, coalesce(i.t, 0) AS triangles,
               round(coalesce(2 * i.l / (n.n * (n.n - 1)), 0), 9) AS clustering_coefficient, CAST(c.kcore AS INT) AS "kCore"
        FROM deg_s d JOIN nbrdeg_s a USING (scenario, id) LEFT JOIN nbn_s n USING (scenario, id)
             LEFT JOIN inner_t_s i USING (scenario, id) JOIN kcore_ts c USING (scenario, id)"""

    def nearest(row: str) -> str:
        distance = " + ".join(f'pow({row}."{c}" - c.c_{c}, 2)' for c in FEATURES)
        return f"arg_min(c.role, ({distance}, c.role))"

    def bot_role(scale: bool) -> str:
        value = ", ".join(
            f"(p.mean_{c} - m.avg_{c}) / CASE WHEN m.std_{c} = 0 THEN 1 ELSE m.std_{c} END AS {c}" if scale else f"p.mean_{c} AS {c}"
            for c in FEATURES
        )
        return (
            f"SELECT {nearest('x')} AS role, n_bots, in_min, in_max, out_min, out_max"
            f" FROM (SELECT p.n_bots, p.in_min, p.in_max, p.out_min, p.out_max, {value} FROM profile p CROSS JOIN means m) x CROSS JOIN centres c GROUP BY ALL"
        )

    sql = {
        "edges_distinct": "SELECT src, dst FROM edges",
        "nodes": "SELECT src AS id FROM edges UNION SELECT dst FROM edges",
        "graph_size": "SELECT (SELECT count(*) FROM deg) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges",
        "in_degree": "SELECT dst AS id, count(*) AS indegree FROM edges GROUP BY dst",
        "out_degree": "SELECT src AS id, count(*) AS outdegree FROM edges GROUP BY src",
        "total_degree": "SELECT id, degree FROM deg",
        "avg_neighbor_degree": "SELECT id, round(d, 9) AS average_neighbor_degree FROM nbrdeg",
        "avg_successor_degree": "SELECT d.id, round(coalesce(sum(t.outdegree), 0) / greatest(any_value(d.outdegree), 1), 9) AS avg_successor_degree"
        " FROM deg d LEFT JOIN edges e ON e.src = d.id LEFT JOIN deg t ON t.id = e.dst GROUP BY d.id",
        "avg_successor_degree_parallel": "SELECT d.id, round(coalesce(sum(t.outdegree), 0) / greatest(any_value(d.outdegree), 1), 9) AS avg_successor_degree"
        " FROM fdeg d LEFT JOIN edges e ON e.src = d.id LEFT JOIN fdeg t ON t.id = e.dst GROUP BY d.id",
        "triangles": "SELECT d.id, coalesce(i.t, 0) AS triangles FROM deg d LEFT JOIN inner_t i USING (id)",
        "clustering_directed": "SELECT d.id, round(coalesce(2 * i.l / (n.n * (n.n - 1)), 0), 9) AS clustering_coefficient"
        " FROM deg d LEFT JOIN nbn n USING (id) LEFT JOIN inner_t i USING (id)",
        "clustering_undirected": "SELECT d.id, round(coalesce(2 * i.t / (n.n * (n.n - 1)), 0), 9) AS clustering_coefficient"
        " FROM deg d LEFT JOIN nbn n USING (id) LEFT JOIN inner_t i USING (id)",
        "k_core": 'SELECT id, CAST(kcore AS INT) AS "kCore" FROM kcore_t',
        "core_sizes": "SELECT CAST(k AS INT) AS k, count(*) AS n_nodes FROM kcore_t CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE kcore >= k GROUP BY k",
        "core_number": "SELECT id, core FROM core_t",
        "pagerank_static": "SELECT id, round(x / (SELECT sum(x) FROM x5), 9) AS pagerank FROM x5",
        "pagerank_converged": "SELECT id, round(x, 9) AS pagerank FROM pr WHERE rnd = (SELECT max(rnd) FROM pr)",
        "harmonic_bounded": "SELECT id, round(coalesce(sum(round(n / d, 5)), 0), 4) AS harmonic FROM (SELECT id FROM deg) LEFT JOIN"
        " (SELECT t AS id, d, count(*) AS n FROM u6 WHERE d > 0 GROUP BY ALL) USING (id) GROUP BY id",
        "harmonic_in": "SELECT id, round(coalesce(sum(n / d), 0), 9) AS harmonic FROM (SELECT id FROM deg) LEFT JOIN"
        " (SELECT t AS id, d, count(*) AS n FROM d6 WHERE d > 0 GROUP BY ALL) USING (id) GROUP BY id",
        "betweenness_pivots": "SELECT d.id, round(coalesce(c, 0) * n / least(n, 64) / ((n - 1) * (n - 2)), 9) AS betweenness"
        " FROM deg d CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM deg) LEFT JOIN btp USING (id)",
        "betweenness": "SELECT d.id, round(coalesce(c, 0) / (((SELECT count(*) FROM deg) - 1) * ((SELECT count(*) FROM deg) - 2)), 9) AS betweenness"
        " FROM deg d LEFT JOIN bt USING (id)",
        "basic_features": "SELECT id, indegree, outdegree, round(a.d, 9) AS average_neighbor_degree"
        " FROM deg JOIN nbrdeg a USING (id)",
        "node_features": "SELECT * REPLACE (round(average_neighbor_degree, 9) AS average_neighbor_degree, round(clustering_coefficient, 9) AS clustering_coefficient) FROM features",
        "node_features_by_scenario": features_s,
        "flow_degrees": "SELECT * FROM fdeg",
        "bot_hosts": "SELECT id FROM bots",
        "missing_bots": "SELECT id FROM bots WHERE id NOT IN (SELECT dst FROM edges)",
        "missing_bots_large": "SELECT id FROM bots WHERE id NOT IN (SELECT src_addr FROM flows WHERE tot_pkts = 50)",
        "bot_profile": "SELECT * REPLACE (" + ", ".join(f"round(mean_{c}, 9) AS mean_{c}" for c in FEATURES) + ") FROM profile",
        "bot_role": bot_role(True),
        "bot_role_unscaled": bot_role(False),
        "bot_candidates": f"""
            SELECT id FROM (SELECT h.id, p.n_bots, row_number() OVER (ORDER BY {_hash_number('bot', 'h.id')}, h.id) AS rn
            FROM rdeg h JOIN fprofile p ON h.role = p.role AND h.indegree BETWEEN p.in_min AND p.in_max AND h.outdegree BETWEEN p.out_min AND p.out_max) WHERE rn <= n_bots""",
        "features_scaled": "SELECT id, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in FEATURES) + " FROM scaled",
        "role_assign": f"SELECT x.id AS node, {nearest('x')} AS role FROM scaled x CROSS JOIN centres c GROUP BY x.id",
        "role_sizes": "SELECT role, n_nodes FROM sizes",
        "scenario_size": "SELECT scenario, CAST(sum(n_nodes) AS BIGINT) AS n_nodes FROM sizes_s GROUP BY scenario",
        "role_edges": "SELECT * REPLACE (round(p_trans, 9) AS p_trans, round(p_joint, 9) AS p_joint) FROM rprob",
        "role_edges_by_scenario": "SELECT * REPLACE (round(p_trans, 9) AS p_trans, round(p_joint, 9) AS p_joint) FROM rprob_s",
        "degree_bins": "SELECT * FROM bins",
        "degree_hist2d": "SELECT * FROM hist",
        "degree_hist2d_dense": "SELECT * FROM hist_dense",
        "degree_hist2d_by_scenario": "SELECT * FROM hist_s",
        "attr_summary": "SELECT * FROM asum",
        "attr_hist_categorical": "SELECT attribute, bin, label, n, total, round(n / total, 9) AS p FROM catb",
        "attr_hist_quantile": "SELECT attribute, bin, round(lo, 9) AS lo, round(hi, 9) AS hi, n, total, round(n / total, 9) AS p FROM qnt",
        "attr_hist_all": "SELECT * REPLACE (round(lo, 9) AS lo, round(hi, 9) AS hi, round(p, 9) AS p) FROM allh",
        "attr_hist_by_scenario": "SELECT * REPLACE (round(lo, 9) AS lo, round(hi, 9) AS hi, round(p, 9) AS p) FROM allh_s",
        "hist_cumulative": "SELECT attribute, bin, n, round(cum_lo, 9) AS cum_lo, round(cum_hi, 9) AS cum_hi FROM cum",
        "degree_distribution": "SELECT degree AS value FROM fdeg",
        "synth_nodes": "SELECT * FROM hosts",
        "synth_nodes_by_scenario": "SELECT * FROM hosts_s",
        "stub_supply": "SELECT * FROM supply",
        "synth_roles": "SELECT * FROM stubs",
        "synth_edges": "SELECT * FROM sedges",
        "synth_attrs": "SELECT * FROM sattrs",
        "synth_labels": f"SELECT e.*, CASE WHEN c.id IS NOT NULL THEN '{BOT_LABEL}' ELSE '{NORMAL_LABEL}' END AS label FROM sedges e LEFT JOIN candidates c ON c.id = e.src",
        "sample_flows": f"SELECT * FROM flows WHERE NOT (contains(label, 'otnet') OR contains(label, 'alicious')) ORDER BY {_order()} LIMIT 50",
        "flows_by_time": "SELECT * FROM flows",
        "flow_csv_roundtrip": "SELECT * FROM flows_s",
        "flow_csv_many_scenarios": "SELECT * REPLACE (CASE WHEN dir = '->' THEN scenario ELSE scenario || '2' END AS scenario) FROM flows_s",
        "flow_csv_mixed_headers": "SELECT * FROM flows_s",
        "flow_csv_concatenated": "SELECT * FROM flows",
        "flow_log_source": "SELECT * FROM flows_s",
        "bracketed_hosts": "SELECT src_addr, dst_addr FROM flows",
        "role_table_stored": "SELECT * FROM roles",
        "role_sizes_stored": "SELECT role, n_nodes FROM sizes",
        "role_edges_stored": "SELECT * REPLACE (round(p_trans, 9) AS p_trans, round(p_joint, 9) AS p_joint) FROM rprob_s",
        "degree_hist_stored": "SELECT * FROM hist",
        "attr_hist_stored": "SELECT * REPLACE (round(lo, 9) AS lo, round(hi, 9) AS hi, round(p, 9) AS p) FROM allh",
        "bot_profile_stored": "SELECT * FROM fprofile",
        "features_csv_stored": "SELECT * REPLACE (round(average_neighbor_degree, 9) AS average_neighbor_degree, round(clustering_coefficient, 9) AS clustering_coefficient) FROM features",
        "flows_csv_ordered": "SELECT row_number() OVER (ORDER BY start_time) - 1 AS rank, strftime(start_time, '%Y-%m-%d') AS day FROM flows",
        "distribution_stored": "SELECT row_number() OVER (ORDER BY degree) - 1 AS rank, degree AS value FROM fdeg",
        "flow_degrees_null_ends": "SELECT id, CAST(sum(i) AS BIGINT) AS indegree, CAST(sum(o) AS BIGINT) AS outdegree, count(*) AS degree FROM fends_d WHERE id IS NOT NULL GROUP BY id",
        "attr_hist_dirty": "SELECT * REPLACE (round(lo, 9) AS lo, round(hi, 9) AS hi, round(p, 9) AS p) FROM allh_d",
        "role_edges_dirty": "SELECT src_role, dst_role, n, round(n / sum(n) OVER (PARTITION BY src_role), 9) AS p_trans, round(n / sum(n) OVER (), 9) AS p_joint FROM redges_d",
        "port_numbers": f"SELECT sport, count(*) AS n, {_numeric('sport', 'port')} AS port FROM dirty GROUP BY sport",
        "roles_kmeans": "SELECT id AS node, CAST(role AS INT) AS role FROM kr",
        "roles_kmeans_by_scenario": "SELECT scenario, id AS node, CAST(role AS INT) AS role FROM kr_s",
        "bot_role_by_scenario": "SELECT x.scenario, CASE WHEN any_value(n_bots) > 0 THEN CAST(arg_min(c.role, ("
        + " + ".join(f"pow(x.{c} - c.{c}, 2)" for c in FEATURES)
        + ", c.role)) AS INT) END AS role, any_value(n_bots) AS n_bots FROM (SELECT p.scenario, p.n_bots, "
        + ", ".join(f"(p.mean_{c} - m.avg_{c}) / CASE WHEN m.std_{c} = 0 THEN 1 ELSE m.std_{c} END AS {c}" for c in FEATURES)
        + " FROM profile_s p JOIN means_s m USING (scenario)) x JOIN kc_s c USING (scenario) GROUP BY x.scenario",
        "flow_bins": "SELECT attribute, bin, n FROM qnt",
        "role_offsets": "SELECT role, id, CAST(coalesce(sum(indegree) OVER w, 0) AS BIGINT) AS first, CAST(coalesce(sum(indegree) OVER w, 0) + indegree AS BIGINT) AS upto"
        " FROM rdeg WINDOW w AS (PARTITION BY role ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
        "role_sample": f"SELECT role, id FROM (SELECT role, id, row_number() OVER (PARTITION BY role ORDER BY {_hash_number('sample', 'id')}, id) AS rn FROM rdeg) WHERE rn <= 20",
        "harmonic_hll_bound": "SELECT id, true AS near FROM deg",
        "triangle_estimate": "SELECT d.scenario, CAST(coalesce(sum(i.t), 0) AS BIGINT) // 3 AS exact, true AS near FROM deg_s d LEFT JOIN inner_t_s i USING (scenario, id) GROUP BY d.scenario",
        "attr_hist_sketch": f"SELECT attribute, count(val) AS n, true AS within FROM ({_attributes('flows', False)}) WHERE val IS NOT NULL GROUP BY attribute",
        "distinct_hosts_overlap": "SELECT DISTINCT scenario, true AS n_hosts, true AS n_stayed, true AS n_new FROM flows_s",
    }
    result = {name: _query(final, ctes) for name, final in sql.items()}
    reports = {
        "hist_equal_width": (_degree_rows("half1", "", True), _degree_rows("half2", "", True), "", "SELECT * FROM ewh"),
        "hist_intersection": ("SELECT * FROM prop1", "SELECT * FROM prop2", "", "SELECT * FROM report_"),
        "validation_report": (_degree_rows("half1", "", False), _degree_rows("half2", "", False), "", "SELECT * FROM report_"),
        "validation_seven": (_binned("seven1"), _binned("seven2"), "", "SELECT * FROM report_"),
        "validation_halves": (
            _degree_rows("half1_s", "scenario, ", False),
            _degree_rows("half2_s", "scenario, ", False),
            "scenario, ",
            "SELECT * FROM report_",
        ),
    }
    for name, (first, second, k, final) in reports.items():
        result[name] = _query(final, {**ctes, **_intersection(first, second, k)})
    return result


def _order() -> str:
    return ", ".join(c.strip() + " NULLS FIRST" for c in FLOW_COLUMNS.split(","))
