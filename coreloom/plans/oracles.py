"""The same results in DuckDB's SQL, written apart from the DataFrame code."""

from __future__ import annotations

from coreloom.functions.rng import normal_sql, uniform_sql
from coreloom.operators.reduce import cw_sketch_sql, rad_sketch_sql, srht_sketch_sql
from coreloom.operators.sampling import weighted_choice_sql

S: dict[str, str] = {}


def d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


P = "p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"
C = "c AS (SELECT id AS cid, v AS c FROM p WHERE id < 5)"
A = f"a AS (SELECT id, v, cid AS cluster, d2 FROM (SELECT id, v, cid, {d2('v', 'c')} AS d2 FROM p, c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, cid) = 1)"
PCA = f"WITH {P}, {C}, {A}"
O = "p AS (SELECT o_orderkey AS id, [o_totalprice / 1000.0::DOUBLE, month(o_orderdate)::DOUBLE] AS v FROM orders), c AS (SELECT id AS cid, v AS c FROM p WHERE id < 10)"
OA = f"WITH {O}, {A}, k AS (SELECT *, sqrt(d2) AS cost FROM a)"
POS = "range(64) t(i)"

S["assign_fixed_centers"] = f"{PCA} SELECT cluster, count(*) AS n, round(sum(d2), 6) AS cost FROM a GROUP BY cluster"
S["cluster_avg_cost"] = f"{PCA} SELECT cluster, round(avg(d2), 6) AS avg_cost FROM a GROUP BY cluster"
S["normalized_cost"] = f"{PCA} SELECT id, round(d2 / (SELECT sum(d2) FROM a), 9) AS share FROM a"
S["cluster_centroids"] = f"{PCA} SELECT cluster, i::INT AS pos, round(avg(v[i + 1]), 6) AS val FROM a, {POS} GROUP BY cluster, i"
S["weighted_centroids"] = f"{PCA} SELECT cluster, i::INT AS pos, round(sum((1 + id % 3) * v[i + 1]) / sum(1 + id % 3), 6) AS val FROM a, {POS} GROUP BY cluster, i"
S["distinct_clusters"] = f"{PCA} SELECT DISTINCT cluster FROM a"
S["real_cost"] = f"{PCA} SELECT round(sum(d2), 6) AS cost FROM a"
S["coreset_cost"] = f"{PCA} SELECT round(sum((1 + id % 7) * d2), 6) AS cost FROM a WHERE id % 10 = 0"
S["distortion_worst_of_5"] = f"""WITH {P}, m AS (SELECT q.id, s.i AS solution, min({d2('q.v', 'c.v')}) AS d2 FROM p q, range(5) s(i), p c WHERE c.id BETWEEN 5 * s.i AND 5 * s.i + 4 GROUP BY ALL),
s AS (SELECT solution, sum(d2) AS r, sum(CASE WHEN id % 10 = 0 THEN (1 + id % 7) * d2 END) AS k FROM m GROUP BY solution)
SELECT solution::INT AS solution, round(r, 6) AS real_cost, round(k, 6) AS coreset_cost, round(greatest(r / k, k / r), 6) AS distortion FROM s ORDER BY greatest(r / k, k / r) DESC, solution LIMIT 1"""
S["coreset_center_cost"] = f"WITH {P} SELECT round(sum(d2), 6) AS cost FROM (SELECT q.id, min({d2('q.v', 'c.v')}) AS d2 FROM p q, p c WHERE c.id % 50 = 0 GROUP BY q.id)"
S["snap_to_points"] = f"WITH {P} SELECT idx, id FROM (SELECT c.id AS idx, q.id, {d2('q.v', 'list_transform(c.v, lambda x: x * 1.01::DOUBLE)')} AS d2 FROM p q, p c WHERE c.id % 10 = 0) QUALIFY row_number() OVER (PARTITION BY idx ORDER BY d2, id) = 1"

R = """r AS (SELECT k.*, d, CASE WHEN d = 0 OR cost < d / 16 THEN 'shortfall' WHEN cost >= d * 32 THEN 'overshot' ELSE 'ring' END AS kind FROM k JOIN (SELECT cluster, avg(cost) AS d FROM k GROUP BY cluster) USING (cluster)),
g AS (SELECT *, CASE WHEN kind <> 'ring' THEN NULL WHEN cost < d / 8 THEN -4 WHEN cost < d / 4 THEN -3 WHEN cost < d / 2 THEN -2 WHEN cost < d THEN -1 WHEN cost < d * 2 THEN 0
  WHEN cost < d * 4 THEN 1 WHEN cost < d * 8 THEN 2 WHEN cost < d * 16 THEN 3 ELSE 4 END::INT AS ring FROM r)"""
B = """b AS (SELECT kind, ring, cluster, count(*) AS n, sum(cost) AS group_cost FROM g WHERE kind <> 'shortfall' GROUP BY ALL),
h AS (SELECT *, sum(group_cost) OVER (PARTITION BY kind, ring) / (SELECT count(DISTINCT cluster) FROM g) AS unit FROM b),
e AS (SELECT *, CASE WHEN group_cost >= unit THEN 0 WHEN group_cost >= unit / 2 THEN 1 WHEN group_cost >= unit / 4 THEN 2 ELSE 3 END AS band FROM h)"""
PLAN = """f AS (SELECT *, 200.0::DOUBLE * group_cost / (SELECT sum(cost) FROM g) AS share FROM e),
j AS (SELECT *, CASE WHEN share < 1 THEN 'snap' WHEN share >= n THEN 'keep' ELSE 'sample' END AS action FROM f),
l AS (SELECT *, CASE WHEN action = 'sample' THEN (200 - coalesce((SELECT sum(n) FROM j WHERE action = 'keep'), 0)) * group_cost / (SELECT sum(group_cost) FROM j WHERE action = 'sample') END AS draws FROM j)"""
S["ring_histogram"] = f"{OA}, {R} SELECT ring, count(*) AS n, round(sum(cost), 4) AS cost FROM g WHERE kind = 'ring' GROUP BY ring"
S["ringless_points"] = f"""{OA}, {R} SELECT cluster, count(*) FILTER (kind = 'shortfall') AS n_short, count(*) FILTER (kind = 'overshot') AS n_over,
  round(coalesce(sum(cost) FILTER (kind = 'overshot'), 0), 4) AS over_cost FROM g WHERE kind <> 'ring' GROUP BY GROUPING SETS ((), (cluster))"""
S["ring_groups"] = f"{OA}, {R}, {B} SELECT cluster, ring, n, round(group_cost, 4) AS group_cost, band FROM e WHERE kind = 'ring'"
S["overshot_groups"] = f"{OA}, {R}, {B} SELECT cluster, n, round(group_cost, 4) AS group_cost, band FROM e WHERE kind = 'overshot'"
S["group_sample_plan"] = f"{OA}, {R}, {B}, {PLAN} SELECT kind, cluster, ring, n, action, round(share, 6) AS share, round(draws, 6) AS draws FROM l"
_GRP = "kind || '/' || cluster || '/' || coalesce(ring::VARCHAR, 'x')"
S["group_sampling_coreset"] = f"""{OA}, {R}, {B}, {PLAN},
n AS (SELECT *, {_GRP} AS grp FROM l), mem AS (SELECT *, {_GRP} AS grp, row_number() OVER (PARTITION BY {_GRP} ORDER BY id) AS rn FROM g WHERE kind <> 'shortfall'),
t AS (SELECT cluster AS idx, sum(w) AS w FROM (SELECT cluster, count(*) AS w FROM g WHERE kind = 'shortfall' GROUP BY ALL UNION ALL SELECT cluster, sum(n) FROM n WHERE action = 'snap' GROUP BY ALL) GROUP BY cluster),
mean AS (SELECT cluster, avg(v[1]) AS x, avg(v[2]) AS y FROM g GROUP BY cluster),
q AS (SELECT grp, n, group_cost, draws, floor(draws)::BIGINT + CASE WHEN {uniform_sql('3r', 'grp')} < draws - floor(draws) THEN 1 ELSE 0 END AS m FROM n WHERE action = 'sample'),
dr AS (SELECT grp, n, group_cost, draws, unnest(range(m)) AS draw FROM q),
s AS (SELECT mem.id, group_cost / (draws * mem.cost) AS w, mem.v FROM dr JOIN mem ON mem.grp = dr.grp AND mem.rn = floor({uniform_sql('3g', 'dr.grp', 'draw')} * n) + 1
  UNION ALL SELECT mem.id, 1.0::DOUBLE, mem.v FROM mem JOIN n ON n.grp = mem.grp WHERE n.action = 'keep')
SELECT idx, true AS is_center, round(w::DOUBLE, 4) AS w, round(x, 6) AS x, round(y, 6) AS y FROM t JOIN mean ON cluster = idx
UNION ALL SELECT id, false, round(sum(w), 4), round(any_value(v[1]), 6), round(any_value(v[2]), 6) FROM s GROUP BY id"""

S["weighted_choice"] = "WITH items AS (SELECT o_orderkey AS id, o_totalprice AS w FROM orders) " + weighted_choice_sql("items", 100, 7)
S["uniform_choice"] = f"""WITH n AS (SELECT o_orderpriority AS grp, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_orderpriority AS grp, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders),
d AS (SELECT grp, n, unnest(range(5)) AS draw FROM n) SELECT d.grp, draw, id FROM d JOIN r ON r.grp = d.grp AND rn = floor({uniform_sql(11, 'd.grp', 'draw')} * n) + 1"""
S["sample_without_replacement"] = f"SELECT o_orderkey AS id FROM orders ORDER BY {uniform_sql(13, 'o_orderkey')}, o_orderkey LIMIT 50"
S["weighted_reservoir"] = f"SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 0 ORDER BY -ln(1.0::DOUBLE - {uniform_sql(17, 'o_orderkey')}) / o_totalprice, o_orderkey LIMIT 50"
S["stochastic_round"] = f"SELECT o_orderkey AS id, (floor(v) + CASE WHEN {uniform_sql(19, 'o_orderkey')} < v - floor(v) THEN 1 ELSE 0 END)::BIGINT AS r FROM (SELECT *, o_totalprice / 1000.0::DOUBLE AS v FROM orders)"
S["normal_vectors"] = f"SELECT s_suppkey AS id, i::INT AS pos, round({normal_sql(23, 's_suppkey', 'i')}, 9) AS x FROM supplier, range(4) t(i)"
S["sensitivity_coreset"] = f"""{PCA}, k AS (SELECT *, sqrt(d2) AS w FROM a), ch AS ({weighted_choice_sql('(SELECT id, sqrt(d2) AS w FROM a)', 100, '1s')}),
s AS (SELECT k.id, cluster, count(*) * (SELECT sum(w) FROM k) / (100.0::DOUBLE * k.w) AS sw, any_value(v[1]) AS x FROM ch JOIN k ON k.id = ch.id GROUP BY k.id, cluster, k.w),
u AS (SELECT cluster, sum(sw) AS used FROM s GROUP BY cluster)
SELECT id AS idx, false AS is_center, round(sw, 5) AS w, round(x, 6) AS x FROM s
UNION ALL SELECT a.cluster, true, round(greatest(0.0::DOUBLE, count(*) - coalesce(any_value(used), 0)), 5), round(avg(v[1]), 6) FROM a LEFT JOIN u ON u.cluster = a.cluster GROUP BY a.cluster"""


def seeds(seed, weight: str = "1") -> str:
    """CTEs s0..s3 of four k-means++ rounds."""
    out = [P, f"s0 AS (SELECT id, v FROM p ORDER BY {uniform_sql(seed, '0', 'id')}, id LIMIT 1)"]
    for r in range(1, 4):
        near = f"least({', '.join(d2('p.v', f'(SELECT v FROM s{j})') for j in range(r))})" if r > 1 else d2("p.v", "(SELECT v FROM s0)")
        out.append(f"m{r} AS (SELECT id, v, {weight} * {near} AS m FROM p), s{r} AS (SELECT id, v FROM m{r} WHERE m > 0 ORDER BY -ln(1.0::DOUBLE - {uniform_sql(seed, str(r), 'id')}) / m, id LIMIT 1)")
    return "WITH " + ", ".join(out)


_ALL = " UNION ALL ".join(f"SELECT id AS cid, {r} AS round FROM s{r}" for r in range(4))
S["kmeanspp_seeds"] = f"{seeds(5)} {_ALL}"
S["weighted_kmeanspp_seeds"] = f"{seeds(6, '(1 + id % 3)')} {_ALL}"
_SC = f"c AS (SELECT id AS cid, v AS c FROM p WHERE id IN (SELECT cid FROM ({_ALL})))"
S["stream_kmpp_coreset"] = f"{seeds(5)}, {_SC}, {A} SELECT cid AS idx, count(*)::DOUBLE AS w, round(any_value(c[1]), 6) AS x FROM a JOIN c ON cid = cluster GROUP BY cid"
S["basic_coreset"] = f"{seeds(5)}, {_SC}, {A} SELECT cluster AS idx, count(*)::DOUBLE AS w, round(avg(v[1]), 6) AS x FROM a GROUP BY cluster"
S["lloyd_one_step"] = f"{PCA} SELECT cluster AS cid, i::INT AS pos, round(avg(v[i + 1]), 6) AS x FROM a, {POS} GROUP BY cluster, i"
S["weighted_lloyd_one_step"] = f"{PCA} SELECT cluster AS cid, i::INT AS pos, round(sum((1 + id % 3) * v[i + 1]) / sum(1 + id % 3), 6) AS x FROM a, {POS} GROUP BY cluster, i"
S["ray_assigned"] = f"""{PCA}, r AS (SELECT a.id, cluster, v, c, i AS ray, v[i] - c[i] AS length FROM a JOIN c ON cid = cluster, range(1, 4) t(i)),
q AS (SELECT *, sqrt({d2('v', 'c')} - pow(length, 2) + pow(length - greatest(length, 0), 2)) AS dist FROM r)
SELECT id, cluster, ray::INT AS ray, round(length, 6) AS length, round(dist, 6) AS dist FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, ray) = 1"""
S["kmeans1d_exact"] = """WITH o AS (SELECT o_orderpriority AS grp, o_orderkey AS id, o_totalprice / 1000.0::DOUBLE AS x FROM orders),
w AS (SELECT grp, row_number() OVER b AS i, sum(x) OVER b AS s, sum(x * x) OVER b AS q FROM o WINDOW b AS (PARTITION BY grp ORDER BY x, id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT grp, count(*) AS n, sum(x) AS ts, sum(x * x) AS tq FROM o GROUP BY grp)
SELECT grp, round(min(cost), 3) AS cost, arg_min(i, cost) AS n_low FROM (SELECT grp, i, q - s * s / i + (tq - q) - (ts - s) * (ts - s) / (n - i) AS cost FROM w JOIN t USING (grp) WHERE i < n) GROUP BY grp"""
S["convex_candidates"] = f"""WITH {P}, c AS (SELECT v, row_number() OVER (ORDER BY id) AS r FROM p WHERE id < 5),
k AS (SELECT i, floor({uniform_sql('29a', 'i')} * 5) + 1 AS ra, floor({uniform_sql('29b', 'i')} * 5) + 1 AS rb, {uniform_sql('29wa', 'i')} / ({uniform_sql('29wa', 'i')} + {uniform_sql('29wb', 'i')}) AS t FROM range(20) g(i))
SELECT i AS cid, round(t * a.v[1] + (1 - t) * b.v[1], 6) AS x, round(t * a.v[64] + (1 - t) * b.v[64], 6) AS y FROM k JOIN c a ON a.r = ra JOIN c b ON b.r = rb"""
S["farthest_point"] = f"WITH {P} SELECT id, round({d2('v', 'list_transform(v, lambda x: 0.1::DOUBLE)')}, 9) AS d2 FROM p ORDER BY d2 DESC, id LIMIT 1"


def hard(k: int, alpha: int, beta: float) -> str:
    return f"h AS (SELECT i AS id, b * {k} + j AS pos, ((CASE WHEN (i // pow({k}, b)::BIGINT) % {k} = j THEN 1.0 ELSE 0.0 END)::DOUBLE - 1.0::DOUBLE / {k}) * pow({beta}::DOUBLE, -b) AS x FROM range({k**alpha}) t(i), range({alpha}) u(b), range({k}) w(j))"


S["hard_instance_rows"] = f"WITH {hard(3, 3, 2.0)} SELECT id, pos::INT AS pos, round(x, 9) AS x FROM h"
S["hard_instance_block_cost"] = f"WITH {hard(4, 4, 2.0)} SELECT round(sum(pow(x - m, 2)), 6) AS cost FROM (SELECT x, avg(x) OVER (PARTITION BY id % 4, pos) AS m FROM h)"
S["hard_instance_eval"] = f"""WITH {hard(3, 3, 1.0)}, pt AS (SELECT id, list(x ORDER BY pos) AS v FROM h GROUP BY id), l AS (SELECT id, v, b AS a, (id // pow(3, b)::BIGINT) % 3 AS i FROM pt, range(3) t(b)),
z AS (SELECT a, i, count(*) AS n, sum(CASE WHEN id % 2 = 0 THEN 1.0 + id % 3 ELSE 0 END) AS mass FROM l GROUP BY ALL),
m AS (SELECT a, i, list(x ORDER BY pos) AS c FROM (SELECT l.a, l.i, h.pos, avg(h.x) AS x FROM l JOIN h ON h.id = l.id GROUP BY ALL) GROUP BY ALL),
g AS (SELECT z.a, z.i, e.eps, c FROM z JOIN m ON m.a = z.a AND m.i = z.i, (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.3), (0.5)) e(eps) WHERE mass >= n * (1.0::DOUBLE - eps)),
d AS (SELECT a, eps, id, min({d2('pt.v', 'g.c')}) AS d2 FROM pt, g GROUP BY ALL),
s AS (SELECT a, eps, sum(d2) AS rc, sum(CASE WHEN id % 2 = 0 THEN (1.0 + id % 3) * d2 ELSE 0 END) AS cc FROM d GROUP BY ALL), q AS (SELECT a, eps, count(*) AS k FROM g GROUP BY ALL)
SELECT b::INT AS block_index, e.eps AS epsilon, coalesce(k, 0) AS n_non_deficient_centers, round(coalesce(cc, 0)::DOUBLE, 6) AS coreset_cost, round(coalesce(rc, 0)::DOUBLE, 6) AS real_cost,
  round(CASE WHEN rc > 0 AND cc > 0 THEN greatest(rc / cc, cc / rc) END::DOUBLE, 6) AS distortion FROM range(3) t(b), (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.3), (0.5)) e(eps) LEFT JOIN q ON q.a = b AND q.eps = e.eps LEFT JOIN s ON s.a = b AND s.eps = e.eps"""
WORDS = "w AS (SELECT doc_id, word, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL)"
S["bow_triples"] = f"WITH {WORDS} SELECT doc_id, dense_rank() OVER (ORDER BY word) AS word_id, cnt FROM w"
CELLS = f"{WORDS}, x AS (SELECT doc_id AS row, least(length(word), 16) - 1 AS col, sum(cnt)::DOUBLE AS val FROM w GROUP BY ALL)"
S["bow_dense_rows"] = f"WITH {CELLS} SELECT row AS id, string_agg(coalesce(val, 0)::BIGINT::VARCHAR, ' ' ORDER BY i) AS v FROM (SELECT r.row, i, val FROM (SELECT DISTINCT row FROM x) r CROSS JOIN range(16) t(i) LEFT JOIN x ON x.row = r.row AND x.col = i) GROUP BY row"
S["csr_rows"] = f"WITH {CELLS}, y AS (SELECT row, count(*) AS n, string_agg(col::VARCHAR, ' ' ORDER BY col) AS cols, string_agg(val::BIGINT::VARCHAR, ' ' ORDER BY col) AS vals FROM x GROUP BY row) SELECT row, (sum(n) OVER (ORDER BY row) - n)::BIGINT AS start, n::INT AS n, cols, vals FROM y"
S["sparse_lookup"] = f"WITH {CELLS} SELECT doc_id AS row, doc_id % 20 AS col, coalesce(val, 0) AS val FROM documents LEFT JOIN x ON x.row = doc_id AND x.col = doc_id % 20"
_OC = "(SELECT o_orderkey AS row, o_custkey % 8 AS col, o_totalprice AS val FROM orders)"
S["cw_sketch"] = f"SELECT row, col, round(val, 2) AS val FROM ({cw_sketch_sql(_OC, 16, 31)})"
S["rad_sketch"] = f"SELECT row, col, round(val, 2) AS val FROM ({rad_sketch_sql(_OC, 8, 37)})"
S["srht_sketch"] = f"SELECT row, col, round(val, 3) AS val FROM ({srht_sketch_sql('(SELECT p_partkey AS row, (p_size % 4)::BIGINT AS col, p_retailprice AS val FROM part)', 32768, 16, 41)})"
S["reduce_dimensions"] = f"WITH {CELLS} SELECT col AS row, row AS col, round(val, 6) AS val FROM ({rad_sketch_sql('(' + cw_sketch_sql('(SELECT col AS row, row AS col, val FROM x)', 8, 43) + ')', 4, 43)})"
S["frobenius_mass"] = f"WITH {P} SELECT round(sum(list_sum(list_transform(v, lambda x: x * x))), 6) AS mass FROM p"
S["frobenius_difference"] = f"WITH {P} SELECT round(sum(list_sum(list_transform(v, lambda x: x * x / 4))), 6) AS mass FROM p"
S["gram_matrix"] = f"WITH {P} SELECT i::INT AS i, j::INT AS j, round(sum(v[i + 1] * v[j + 1]), 6) AS val FROM p, range(64) t(i), range(64) u(j) WHERE i <= j GROUP BY i, j"
_Z = "list_transform(list_zip({0}, {1}), lambda z: {2})"
S["l1_lp_kl_distances"] = f"""WITH {P}, q AS (SELECT p.id, p.v, c.v AS c, list_transform(p.v, lambda x: abs(x) + 0.01::DOUBLE) AS a, list_transform(c.v, lambda x: abs(x) + 0.01::DOUBLE) AS b FROM p, p c WHERE c.id = 0)
SELECT id, round(list_sum({_Z.format('v', 'c', 'abs(z[1] - z[2])')}), 6) AS l1, round(pow(list_sum({_Z.format('v', 'c', 'pow(abs(z[1] - z[2]), 3)')}), 1.0::DOUBLE / 3), 6) AS l3,
  round(list_sum({_Z.format('a', 'b', 'z[1] * ln(z[1] / z[2])')}) - list_sum(a) + list_sum(b), 6) AS kl, round(sqrt({d2('v', 'c')}), 6) AS l2, round(list_sum({_Z.format('v', 'c', 'z[1] * z[2]')}), 6) AS dot FROM q"""
S["cf_summary"] = f"{PCA} SELECT cluster, count(*)::DOUBLE AS n, round(sum(list_sum(list_transform(v, lambda x: x * x))), 6) AS ss, round(sum(v[1]), 6) AS ls0, round(sum(v[64]), 6) AS ls63 FROM a GROUP BY cluster"
S["cf_merge_cost"] = f"{PCA}, m AS (SELECT cluster, i, avg(v[i + 1]) AS m FROM a, {POS} GROUP BY ALL) SELECT a.cluster, count(DISTINCT id)::DOUBLE AS n, round(sum(pow(v[i + 1] - m, 2)), 6) AS cost FROM a JOIN m ON m.cluster = a.cluster GROUP BY a.cluster"
S["stream_cf_coreset"] = "SELECT count(*) AS n, round(sum(value), 3) AS ls0, round(sum(hour(ts)::DOUBLE), 3) AS ls1, round(sum(value * value + hour(ts) * hour(ts)), 2) AS ss FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND NOT isnan(value)"
S["cf_coreset"] = "SELECT count(*) AS n, round(sum(o_totalprice / 1000.0::DOUBLE), 2) AS s0, round(sum(month(o_orderdate)::DOUBLE), 2) AS s1 FROM orders"
S["results_summary"] = """SELECT p_brand AS dataset, p_type AS algorithm, count(*) AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS std, round(median(p_retailprice), 4) AS median, round(max(p_retailprice), 4) AS max
FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) <= 10) GROUP BY ALL"""
S["results_pivot"] = "SELECT o_orderstatus, round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 4) AS urgent, round(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW'), 4) AS low FROM orders GROUP BY o_orderstatus"
S["cost_ratio"] = "SELECT p_brand AS dataset, p_size AS k, p_type AS algorithm, min(p_retailprice) AS low, max(p_retailprice) AS high, round(max(p_retailprice) / min(p_retailprice), 6) AS ratio FROM part GROUP BY ALL"
S["minmax_normalized"] = "SELECT p_partkey AS seq, round((p_retailprice - min(p_retailprice) OVER b) / nullif(max(p_retailprice) OVER b - min(p_retailprice) OVER b, 0), 6) AS norm FROM part WINDOW b AS (PARTITION BY p_brand)"
S["group_maxima"] = "SELECT p_brand AS dataset, max(p_retailprice) AS max_distortion, max(p_size) AS max_k FROM part GROUP BY p_brand"
S["mean_std_label"] = """WITH s AS (SELECT p_type AS algorithm, count(*) AS n, avg(p_size) AS m, stddev_samp(p_size) AS sd FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) <= 10) GROUP BY p_type)
SELECT algorithm, printf('%.2f', m) || ' (' || coalesce(printf('%.3f', sd), 'nan') || ')' AS label, 'k=' || n AS k_label, printf('%02dh %02dm %02ds', floor(m * 1000)::BIGINT // 3600, floor(m * 1000)::BIGINT // 60 % 60, floor(m * 1000)::BIGINT % 60) AS took FROM s"""
S["dataset_labels"] = "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'Ring' WHEN contains(p_name, 'widget') THEN 'Widget' END AS label FROM part"
S["unprocessed_runs"] = "SELECT 'run-' || o_orderkey AS name, o_custkey FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY 'run-' || o_orderkey) = 1"
S["run_states"] = """WITH r AS (SELECT o_custkey % 700 AS name, row_number() OVER (PARTITION BY o_custkey % 700 ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT CASE WHEN rn > 1 THEN 'discarded' WHEN name IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 'completed' WHEN name IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'in-progress' ELSE 'ready' END AS status, count(*) AS n FROM r GROUP BY 1"""
S["experiment_grid"] = "SELECT r_name AS dataset, n_name AS algorithm, (10 * k)::INT AS k, i::INT AS iteration, (2000 * k)::INT AS m FROM region, nation, range(1, 6) a(k), range(1, 4) b(i)"
S["alias_resolution"] = "SELECT p_partkey, CASE lower(p_brand) WHEN 'brand#1' THEN 'one' WHEN 'brand#2' THEN 'two' ELSE 'b' || substr(p_brand, 7) END AS p_brand FROM part"
S["drop_nan_rows"] = f"WITH {P} SELECT count(*) AS n, round(sum(list_sum(list_transform(v, lambda x: x * x))), 6) AS mass FROM p WHERE id % 7 <> 0"
S["local_search_swap"] = f"""WITH {P}, e AS (SELECT x.id, c.id AS c, {d2('x.v', 'c.v')} AS d2 FROM p x, p c),
s AS (SELECT i AS closed, id, min(d2) AS d_stay FROM e, range(5) t(i) WHERE c BETWEEN 0 AND 4 AND c <> i GROUP BY ALL)
SELECT closed, c AS opened, round(sum(least(d_stay, d2)), 6) AS cost FROM s JOIN e USING (id) WHERE c NOT BETWEEN 0 AND 4 GROUP BY ALL"""

S["row_gather"] = f"WITH {P} SELECT id, round(v[1], 6) AS x FROM p WHERE id % 9 = 2"
S["cluster_members"] = f"{PCA} SELECT id FROM a WHERE cluster = 2"
S["overshot_members"] = f"{OA} SELECT id, cluster FROM k JOIN (SELECT cluster, avg(cost) AS d FROM k GROUP BY cluster) USING (cluster) WHERE d > 0 AND cost >= d * 2"
S["bad_coordinates"] = f"WITH {P} SELECT sum(CASE WHEN id % 11 = 0 THEN len(v) ELSE 0 END)::BIGINT AS n_nan, sum(CASE WHEN id % 11 <> 0 AND id % 13 = 0 THEN len(v) ELSE 0 END)::BIGINT AS n_inf FROM p"
S["set_intersection"] = f"WITH {P} SELECT id FROM p WHERE id % 2 = 0 INTERSECT SELECT id FROM p WHERE id % 3 = 0"
S["set_difference"] = f"WITH {P} SELECT id FROM p WHERE id % 2 = 0 EXCEPT SELECT id FROM p WHERE id % 3 = 0"
S["prefix_sums"] = """SELECT grp, id, row_number() OVER b - 1 AS rank, (sum(x) OVER b)::BIGINT AS sum, (sum(x * x) OVER b)::BIGINT AS sum2
FROM (SELECT o_orderpriority AS grp, o_orderkey AS id, floor(o_totalprice)::BIGINT AS x FROM orders) WINDOW b AS (PARTITION BY grp ORDER BY x, id ROWS UNBOUNDED PRECEDING)"""
S["paired_files"] = """WITH f AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'f' || (p_partkey // 4) || '-svd-d5.csv' ELSE 'f' || (p_partkey // 3) || '.csv' END AS path FROM part)
SELECT r.path AS reduced, o.path AS original FROM f r JOIN f o ON contains(r.path, '-svd') AND o.path = replace(r.path, '-svd-d5', '')"""
S["nearest_l1"] = f"WITH {P}, {C} SELECT id, cid AS cluster, round(d, 6) AS dist FROM (SELECT id, cid, list_sum({_Z.format('v', 'c', 'abs(z[1] - z[2])')}) AS d FROM p, c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cid) = 1"
S["partition_costs"] = f"WITH {P}, {C} SELECT cid AS cluster, round(sum({d2('v', 'c')}), 6) AS cost FROM p JOIN c ON cid = id % 5 GROUP BY cid"
S["pairwise_distances"] = f"WITH {P} SELECT x.id AS a, y.id AS b, round({d2('x.v', 'y.v')}, 6) AS dist FROM p x, p y"
S["union_of_frames"] = "SELECT c_custkey AS id, c_acctbal AS x FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier"

S["dense_csv_round_trip"] = f"WITH {P} SELECT i::INT AS pos, count(*) AS n, round(sum(v[i + 1]), 6) AS total FROM p, {POS} GROUP BY i"
S["coreset_round_trip"] = f"WITH {P} SELECT count(*) AS n, sum(1 + id % 7)::DOUBLE AS w, round(sum((1 + id % 7) * list_sum(list_transform(v, lambda x: x * x))), 6) AS mass FROM p WHERE id % 10 = 0"
S["centers_round_trip"] = f"WITH {P}, {C} SELECT cid, i::INT AS pos, round(c[i + 1], 9) AS x FROM c, {POS}"
S["tower_points"] = """WITH n AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS ln FROM nation)
SELECT ln // 3 AS id, max(k) FILTER (ln % 3 = 0)::DOUBLE AS x0, max(k) FILTER (ln % 3 = 1)::DOUBLE AS x1, max(k) FILTER (ln % 3 = 2)::DOUBLE AS x2 FROM n GROUP BY ln // 3 HAVING count(*) = 3"""
S["census_points"] = "SELECT n_regionkey::DOUBLE AS x0, (n_nationkey * 10)::DOUBLE AS x1 FROM nation"
S["covertype_points"] = "SELECT n_nationkey::DOUBLE AS x0, n_regionkey::DOUBLE AS x1 FROM nation"

_F = "f AS (SELECT p_brand AS dataset, p_size AS k, p_partkey AS seq, p_retailprice AS x, CASE WHEN p_partkey % 3 = 0 THEN 500 ELSE 200 END AS m FROM part)"
S["assign_pruned"] = f"{PCA} SELECT id, cluster, round(d2, 6) AS d2 FROM a"
S["squared_distances"] = f"""WITH {P} SELECT p.id, round(pow(list_sum({_Z.format('p.v', 'c.v', 'abs(z[1] - z[2])')}), 2), 4) AS l1, round(pow(list_sum({_Z.format('p.v', 'c.v', 'pow(abs(z[1] - z[2]), 3)')}), 2.0::DOUBLE / 3), 5) AS l3 FROM p, p c WHERE c.id = 0"""
S["filtered_facts"] = f"""WITH {_F} SELECT seq, dataset, k FROM f WHERE m = 200 AND dataset NOT IN ('Brand#11', 'Brand#25')
AND NOT (contains(dataset, '#3') AND k < 20) AND NOT (contains(dataset, '#4') AND k < 30)"""
S["results_pivot_max"] = f"WITH {_F} SELECT dataset, k, round(max(x) FILTER (m = 200), 4) AS m200, round(max(x) FILTER (m = 500), 4) AS m500 FROM f WHERE k <= 10 GROUP BY dataset, k"
S["results_pivot_join"] = f"""WITH {_F}, c AS (SELECT dataset, m, printf('%02d:%d', k, count(*)) AS x FROM f GROUP BY dataset, m, k)
SELECT dataset, coalesce(string_agg(x, ', ' ORDER BY x) FILTER (m = 200), '') AS m200, coalesce(string_agg(x, ', ' ORDER BY x) FILTER (m = 500), '') AS m500 FROM c GROUP BY dataset"""
S["latex_lines"] = r"""WITH s AS (SELECT p_brand AS b, p_type AS t, avg(p_size) AS m, stddev_samp(p_size) AS sd FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) <= 10) GROUP BY ALL)
SELECT replace(b, '#', '\#') || ' & ' || t || ' & ' || printf('%.2f', m) || ' (' || coalesce(printf('%.3f', sd), 'nan') || ')' || ' \\' AS line FROM s"""
S["instance_names"] = "SELECT p_partkey, p_size::INT AS k, (p_partkey % 7)::INT AS alpha, 1.25::DOUBLE AS beta FROM part"
S["stream_text_summary"] = "SELECT count(*) AS n, sum(o_custkey)::DOUBLE AS ls0, sum(month(o_orderdate))::DOUBLE AS ls1 FROM orders"
