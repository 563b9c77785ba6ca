"""Queries over the graph of customers, suppliers, parts and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.functions.scratch import materialise, scratch_path
from casegraph.operators import graph as G
from casegraph.operators import patterns as P
from casegraph.operators import roles as R
from casegraph.operators import subgraphs as B
from casegraph.operators import traverse as T
from casegraph.plans.driver_views import calls, edges, memberships, table, transfers, vertices, with_views
from casegraph.plans.sqltext import clamp4, sig
from casegraph.sources import io as O
from casegraph.plans.transfer_queries import FLOWS, HUB, LAYERING, LEGS, MULE, RAPID, VELOCITY

BOTH = "both_ways AS (SELECT src AS id, dst AS nbr, rel, confidence FROM edges UNION ALL SELECT dst, src, rel, confidence FROM edges)"


def _ve(spark, d):
    return vertices(spark, d), edges(spark, d)


def account_transfers(spark, d):
    """Transfers between the graph's account vertices: orders pay suppliers' accounts from the customer."""
    t = transfers(spark, d)
    as_supplier = lambda c: F.concat(F.lit("S"), F.substring(c, 2, 20))
    return t.withColumns({"src": as_supplier(F.col("src")), "dst": as_supplier(F.col("dst"))})


def hub_edges(spark, d):
    return P.hub_edges(*_ve(spark, d), rels=("TRANSFERRED_TO",))


def sim_swap(spark, d):
    return P.sim_swap(*_ve(spark, d), account_transfers(spark, d))


def shared_device(spark, d):
    return P.shared_device(*_ve(spark, d))


def shared_sim(spark, d):
    return P.shared_sim(*_ve(spark, d))


def triangles(spark, d):
    return T.triangles(edges(spark, d)).select(F.array_join("members", ">").alias("members"))


def dense_clusters(spark, d):
    v, e = _ve(spark, d)
    c = P.dense_clusters(T.maximal_cliques(e), v)
    return c.withColumn("members", F.array_join("members", ">")).withColumn("n", F.col("n").cast("long"))


def findings_all(spark, d):
    v, e = vertices(spark, d), materialise(edges(spark, d))  # five detectors read them
    t = transfers(spark, d)
    return P.findings(
        sim_swap=P.sim_swap(v, e, account_transfers(spark, d)), mule=P.mule(t, 0.05), rapid_hop=P.rapid_hop(t), shared_device=P.shared_device(v, e), shared_sim=P.shared_sim(v, e),
        velocity=P.velocity(t), comm_hub=P.comm_hub(calls(spark, d), ratio=1.02), hub_edges=P.hub_edges(v, e, rels=("TRANSFERRED_TO",)), dense_cluster=P.dense_clusters(T.maximal_cliques(e), v), layering=P.layering(t),
    )


def analysis(spark, d):
    return P.analysis(findings_all(spark, d))


def analysis_stored(spark, d):
    """The analysis stored by case, one case replaced and read back."""
    path = scratch_path(spark)
    found = materialise(analysis(spark, d))
    O.replace_case(found.unionByName(found.withColumn("case_id", F.lit("c2"))), path)
    O.replace_case(found.withColumns({"case_id": F.lit("c2"), "total": F.lit(0).cast("long")}), path)
    return O.of_stored(spark, path, "c1").unionByName(O.of_stored(spark, path, "c2")).select("case_id", "total", "top_score", "by_pattern")


def graph_filter(spark, d):
    _, e = G.filter_graph(*_ve(spark, d), types=["person", "bank_account"], rels=["transferred_to"], min_confidence=0.5, evidence_source="inferred")
    return e


def graph_build(spark, d):
    v, e = _ve(spark, d)
    # Supplier pairs in both tables of edges: the later one counts.
    e = e.withColumn("seq", F.when(F.col("rel") == "LINKED_TO", 2).otherwise(1)).unionByName(e.where("rel = 'USES'").withColumns({"rel": F.lit("OWNS"), "seq": F.lit(3)}))
    v = v.where("type <> 'DEVICE'").withColumn("seq", F.lit(1))
    return G.build(v, e)[1].select("src", "dst", "rel", "confidence")


def ego2(spark, d):
    e = edges(spark, d)
    seeds = vertices(spark, d).where("type = 'SIM'").select(F.col("id").alias("seed"))
    return T.ego(seeds, e.where("rel IN ('USES', 'LINKED_TO')"), 2, "both")


def shortest_path(spark, d):
    e = edges(spark, d)
    pairs = vertices(spark, d).where("type = 'SIM'").select(F.lit("P1").alias("source"), F.col("id").alias("target"))
    out = T.shortest_paths(pairs, e)
    return out.select("source", "target", F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"), "directed")


def _pay(e):
    """Money edges of several hops: customers pay suppliers, suppliers pay through their nation."""
    return e.where("rel = 'TRANSFERRED_TO'").unionByName(e.where("rel = 'LINKED_TO' AND src LIKE 'S%'").withColumn("rel", F.lit("PAID_TO")))


def money_paths(spark, d):
    pairs = vertices(spark, d).where("type = 'SIM'").select(F.lit("C1").alias("source"), F.col("id").alias("target"))
    out = T.money_paths(pairs, _pay(edges(spark, d)))
    return out.select("source", "target", F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"), F.col("rank").cast("long").alias("rank"))


def _told(paths):
    return paths.select("source", "target", F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"), F.col("rank").cast("long").alias("rank"))


def money_paths_whole(spark, d):
    """From every customer to every nation's SIM."""
    pairs = vertices(spark, d).where("type = 'PERSON'").select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n"))
    return _told(T.money_paths(pairs.select("source", F.concat(F.lit("N"), F.col("n").cast("string")).alias("target")), _pay(edges(spark, d))))


def money_paths_accounts(spark, d):
    """Between the accounts of the transfers that share a description and an amount to within ten, over all transfers."""
    t = transfers(spark, d).where("src IS NOT NULL AND dst IS NOT NULL")
    near = t.select("description", F.floor(F.col("amount") / 10).alias("tens"), "src", "dst")
    ends = lambda c: near.select("description", "tens", c).distinct()
    pairs = ends("src").join(ends("dst"), ["description", "tens"]).where("src <> dst").select(F.col("src").alias("source"), F.col("dst").alias("target"))
    return _told(T.money_paths(pairs, t.select("src", "dst", F.lit("TRANSFERRED_TO").alias("rel")), max_hops=4))


def shortest_paths_whole(spark, d):
    """For every order, from its customer to the customer and the nation numbered like it, most of them no neighbours."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").agg(F.count("*").alias("n"))
    to = F.explode(F.array(F.concat(F.lit("C"), (F.col("o_orderkey") % F.col("n") + 1).cast("string")), F.concat(F.lit("N"), (F.col("o_orderkey") % 25).cast("string"))))
    pairs = o.join(F.broadcast(customers)).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("source"), to.alias("target"))  # one row
    out = T.shortest_paths(pairs, edges(spark, d))
    return out.select("source", "target", F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"), "directed")


def components(spark, d):
    v, e = _ve(spark, d)
    return T.components(v, e.where("rel = 'USES'"))


def component_sizes(spark, d):
    v, e = _ve(spark, d)
    s = T.component_sizes(T.components(v, e.where("rel = 'USES'")))
    return s.withColumn("index", F.col("index").cast("long"))


def components_whole(spark, d):
    """Over the edges of every relation."""
    return T.components(*_ve(spark, d))


def component_sizes_whole(spark, d):
    return T.component_sizes(components_whole(spark, d)).withColumn("index", F.col("index").cast("long"))


def _graphs_stored(spark, d):
    """The graph of who belongs to which nation, stored by component in some 32 parts; a part's vertices are on their own."""
    v, e = _ve(spark, d)
    e = e.where("dst LIKE 'N%'")
    path, of = scratch_path(spark), materialise(T.components(v, e))
    B.store(v, e, of, path, max(1, v.count() // 32))
    return path, of


def component_graphs(spark, d):
    """Every component's vertices and edges, stored and read back."""
    path, _ = _graphs_stored(spark, d)
    v, e = B.component_graphs(spark, path, B.index(spark, path))
    e = e.groupBy("component").agg(F.count("*").alias("n_edges"), F.min("src").alias("first_src"), F.max("src").alias("last_src"))
    return v.groupBy("component").agg(F.count("*").alias("n_vertices")).join(e, "component", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def component_graphs_of_nations(spark, d):
    """The vertices and degrees of the components that hold a nation, which alone are read, with the size that the index tells."""
    path, of = _graphs_stored(spark, d)
    v, e = B.component_graphs(spark, path, of.where("id LIKE 'N%'"))
    out = v.select("component", "id").join(G.degrees(e).select("id", "in_degree", "out_degree"), "id", "left")
    return out.join(B.index(spark, path).select("component", F.col("n_vertices").alias("size")), "component").select("component", "id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"), "size")


def search(spark, d):
    return G.search(vertices(spark, d), "aTION").select("id", "type", "label")


def node_detail(spark, d):
    return G.node_detail(*_ve(spark, d))


def degree(spark, d):
    return G.degrees(edges(spark, d))


def typed_nbrs(spark, d):
    return G.typed_neighbours(*_ve(spark, d))


def pagerank3(spark, d):
    v, e = _ve(spark, d)
    return T.pagerank(v, e, fixed_rounds=3).withColumn("rank", F.round("rank", 9))


def pagerank_whole(spark, d):
    """To its tolerance."""
    return T.pagerank(*_ve(spark, d))


def betweenness_small(spark, d):
    """All vertices, along what joins every customer and supplier with its nation: from every source of a forest of stars."""
    return T.betweenness(vertices(spark, d), memberships(spark, d)).withColumn("betweenness", F.round("betweenness", 9))


def _stars(spark, d):
    """Customers, suppliers and nations with the links to their nation: 25 stars, whose centralities SQL can tell."""
    v, e = _ve(spark, d)
    return v.where("type <> 'DEVICE'"), e.where("dst LIKE 'N%'")


def _calls_of_suppliers(spark, d):
    return calls(spark, d).withColumns({x: F.concat(F.lit("S"), F.substring(x, 2, 20)) for x in ("caller", "receiver")})


def roles_stars(spark, d):
    """All six roles with betweenness from every source and PageRank, on the stars."""
    v, e = _stars(spark, d)
    return R.assign(v, e, account_transfers(spark, d), _calls_of_suppliers(spark, d), T.betweenness(v, e), T.pagerank(v, e, fixed_rounds=3))


def roles_assigned(spark, d):
    r = roles_stars(spark, d)
    return r.select("id", *[F.round(c, 3).alias(c) for c in ("coordinator", "intermediary", "mule", "technical", "victim", "unknown")], "primary_role", F.size("evidence").alias("n_evidence"), (F.length("explanation") > 0).alias("explained"))


def roles_stored(spark, d):
    """Vertices by role, stored by case and read back."""
    path = scratch_path(spark)
    O.replace_case(R.tally(roles_stars(spark, d).withColumn("case_id", F.lit("c1")), "case_id"), path)
    return O.of_stored(spark, path, "c1").select("case_id", "primary_role", "n")


def betweenness_whole(spark, d):
    """Over all vertices and edges, to within 0.05 with a chance of nine in ten (all sources take vertices times edges)."""
    return T.betweenness_within(*_ve(spark, d))


def roles_whole(spark, d):
    """All six roles over the whole graph, with betweenness to within 0.05 and PageRank to its tolerance."""
    v, e = _ve(spark, d)
    r = R.assign(v, e, account_transfers(spark, d), _calls_of_suppliers(spark, d), T.betweenness_within(v, e), T.pagerank(v, e))
    return r.select("id", "primary_role", "role_score", F.array_join("evidence", "; ").alias("evidence"))


def role_volumes(spark, d):
    c = calls(spark, d).withColumns({x: F.concat(F.lit("S"), F.substring(x, 2, 20)) for x in ("caller", "receiver")})
    out = R.volumes(vertices(spark, d).where("type = 'BANK_ACCOUNT'"), account_transfers(spark, d), c)
    return out.select("id", "received", "n_in", "forwarded", "n_out", "calls_in", "calls_out", F.round("fwd", 6).alias("fwd"))


def roles_local(spark, d):
    v, e = _ve(spark, d)
    c = calls(spark, d).withColumns({x: F.concat(F.lit("S"), F.substring(x, 2, 20)) for x in ("caller", "receiver")})
    m = R.measured(v, e, account_transfers(spark, d), c)
    s = R.scores()
    return m.select("id", *[F.round(s[k], 4).alias(k) for k in ("mule", "technical", "victim")])


SUPPLIER = "transfers AS (SELECT id, case_id, 'S' || src[2:] AS src, 'S' || dst[2:] AS dst, amount, us FROM t0)"


def _supplier_transfers(sql: str, *views: str) -> str:
    made = with_views(f", {SUPPLIER} {sql}", "transfers", *views)
    return made.replace("transfers AS (SELECT event_id", "t0 AS (SELECT event_id", 1)


TRI = """und AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
deg AS MATERIALIZED (SELECT id, count(*) AS d FROM (SELECT unnest([a, b]) AS id FROM und) GROUP BY id),
arc AS MATERIALIZED (SELECT CASE WHEN (x.d, a) < (y.d, b) THEN a ELSE b END AS u, CASE WHEN (x.d, a) < (y.d, b) THEN b ELSE a END AS v FROM und JOIN deg x ON x.id = a JOIN deg y ON y.id = b),
wedge AS MATERIALIZED (SELECT p.u, p.v, q.v AS w FROM arc p JOIN arc q ON p.u = q.u AND p.v < q.v),
tri AS (SELECT m[1] AS a, m[2] AS b, m[3] AS c FROM (SELECT list_sort([u, v, w]) AS m FROM wedge JOIN und ON und.a = v AND und.b = w))"""
HUBE = f"SELECT src AS id, count(*) AS n, {clamp4(sig('count(*)', 6, 0.3))} AS score, 0.5::DOUBLE AS confidence FROM edges WHERE rel = 'TRANSFERRED_TO' AND src IN (SELECT id FROM vertices WHERE type IN ('PHONE', 'PERSON')) GROUP BY src HAVING count(*) >= 4"
SWAP = f"""{LEGS}, {BOTH}, tx AS (SELECT account, count(*) AS tx FROM legs GROUP BY account),
ph AS (SELECT b.id AS sim, b.nbr AS phone FROM both_ways b JOIN vertices s ON s.id = b.id AND s.type = 'SIM' JOIN vertices p ON p.id = b.nbr AND p.type IN ('PHONE', 'PERSON')),
ac AS (SELECT b.id AS phone, count(*) AS n, sum(tx.tx) AS tx FROM both_ways b JOIN vertices a ON a.id = b.nbr AND a.type = 'BANK_ACCOUNT' LEFT JOIN tx ON tx.account = b.nbr GROUP BY b.id),
g AS (SELECT sim AS id, count(*) AS n_phones, coalesce(sum(ac.n), 0)::BIGINT AS n_accounts, coalesce(sum(ac.tx), 0)::BIGINT AS tx FROM ph LEFT JOIN ac ON ac.phone = ph.phone GROUP BY sim)
SELECT *, {clamp4(f"least({sig('n_phones', 3, 1.2)} + 0.3 * {sig('tx', 3, 0.4)}, 1.0)")} AS score, CASE WHEN tx > 0 THEN 0.7::DOUBLE ELSE 0.6 END AS confidence FROM g WHERE n_phones >= 2 AND n_accounts >= 1"""


def _shared(hub: str, of: str, least: int, mid: float, slope: float, conf: str) -> str:
    return f"""SELECT b.id, count(DISTINCT b.nbr) AS n, {clamp4(sig('count(DISTINCT b.nbr)', mid, slope))} AS score, {conf} AS confidence FROM both_ways b
  JOIN vertices h ON h.id = b.id AND h.type = '{hub}' JOIN vertices o ON o.id = b.nbr AND o.type IN ({of}) GROUP BY b.id HAVING count(DISTINCT b.nbr) >= {least}"""


DEV = _shared("DEVICE", "'BANK_ACCOUNT', 'PERSON'", 3, 4, 0.8, "CASE WHEN count(DISTINCT b.nbr) >= 5 THEN 0.7::DOUBLE ELSE 0.55 END")
SIM = _shared("SIM", "'BANK_ACCOUNT', 'PERSON', 'PHONE'", 2, 3, 1.0, "0.65::DOUBLE")
DENSE = f"""m AS (SELECT a || '>' || b || '>' || c AS members, unnest([a, b, c]) AS id FROM tri),
q AS (SELECT members, 3::BIGINT AS n, coalesce(avg(risk), 0.0) AS avg_risk FROM m JOIN vertices USING (id) GROUP BY members)
SELECT members, n, round(avg_risk, 4) AS avg_risk, {clamp4(f"least(0.5 * {sig('n', 5, 0.6)} + 0.3 + 0.2 * avg_risk, 1.0)")} AS score, 0.75::DOUBLE AS confidence FROM q"""
VOLUMES = f"""{LEGS}, {FLOWS}, c2 AS (SELECT 'S' || caller[2:] AS caller, 'S' || receiver[2:] AS receiver FROM calls),
co AS (SELECT id, sum(o)::BIGINT AS calls_out, sum(i)::BIGINT AS calls_in FROM (SELECT caller AS id, 1 AS o, 0 AS i FROM c2 UNION ALL SELECT receiver, 0, 1 FROM c2) GROUP BY id),
vol AS (SELECT v.id, v.type, v.risk, coalesce(received, 0) AS received, coalesce(n_in, 0) AS n_in, coalesce(forwarded, 0) AS forwarded, coalesce(n_out, 0) AS n_out, coalesce(calls_in, 0) AS calls_in,
  coalesce(calls_out, 0) AS calls_out, CASE WHEN received > 0 AND forwarded > 0 THEN forwarded / received ELSE 0.0 END AS fwd FROM vertices v LEFT JOIN flows f ON f.account = v.id LEFT JOIN co ON co.id = v.id)"""
DEGREE = """dg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree, sum(c)::DOUBLE AS weight
  FROM (SELECT src AS id, 0 AS i, 1 AS o, confidence::DECIMAL(18,4) AS c FROM edges UNION ALL SELECT dst, 1, 0, confidence::DECIMAL(18,4) FROM edges) GROUP BY id)"""
TYPED = """ty AS (SELECT b.id, count(*) FILTER (v.type = 'BANK_ACCOUNT') AS accounts, count(*) FILTER (v.type = 'DEVICE') AS devices, count(*) FILTER (v.type = 'SIM') AS sims
  FROM both_ways b JOIN vertices v ON v.id = b.nbr GROUP BY b.id)"""
ROLES = f"""{VOLUMES}, {BOTH}, {DEGREE}, {TYPED}, x AS (SELECT vol.*, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree,
  coalesce(accounts, 0) AS accounts, coalesce(devices, 0) AS devices, coalesce(sims, 0) AS sims FROM vol LEFT JOIN dg USING (id) LEFT JOIN ty USING (id))
SELECT id, round(CASE WHEN type = 'BANK_ACCOUNT' OR (received > 0 AND forwarded > 0) THEN 0.5 * {sig('fwd', 0.8, 8)} + 0.3 * {sig('n_in', 3, 0.8)} + 0.2 * (1 - {sig('degree', 6, 0.5)}) ELSE 0.0 END, 4) AS mule,
  round(CASE WHEN type IN ('DEVICE', 'SIM') THEN 0.7 * {sig('accounts + devices + sims + degree', 3, 0.7)} + 0.3 * {sig('degree', 4, 0.5)} ELSE 0.0 END, 4) AS technical,
  round(least((CASE WHEN coalesce(risk, 0) < 0.3 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN in_degree > 0 AND out_degree = 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN received > 0 AND forwarded = 0 THEN 0.2::DOUBLE ELSE 0 END), 0.8), 4) AS victim FROM x"""
EGO = """SELECT seed, id, min(hops)::INTEGER AS hops FROM (SELECT id AS seed, id, 0 AS hops FROM vertices WHERE type = 'SIM'
  UNION ALL SELECT v.id, a.nbr, 1 FROM vertices v JOIN lk a ON a.id = v.id WHERE v.type = 'SIM'
  UNION ALL SELECT v.id, b.nbr, 2 FROM vertices v JOIN lk a ON a.id = v.id JOIN lk b ON b.id = a.nbr WHERE v.type = 'SIM') GROUP BY seed, id"""
SHORTEST = """, d2 AS (SELECT e2.dst AS target, array_to_string(min(['P1', e1.dst, e2.dst]), '>') AS p FROM edges e1 JOIN edges e2 ON e2.src = e1.dst WHERE e1.src = 'P1' GROUP BY e2.dst),
u3 AS (SELECT c.nbr AS target, array_to_string(min(['P1', a.nbr, b.nbr, c.nbr]), '>') AS p FROM both_ways a JOIN both_ways b ON b.id = a.nbr JOIN both_ways c ON c.id = b.nbr
  WHERE a.id = 'P1' AND c.nbr LIKE 'N%' GROUP BY c.nbr)
SELECT 'P1' AS source, n.id AS target, coalesce(d2.p, u3.p) AS path, CASE WHEN d2.p IS NOT NULL THEN 2 ELSE 3 END::BIGINT AS length, d2.p IS NOT NULL AS directed
FROM vertices n LEFT JOIN d2 ON d2.target = n.id LEFT JOIN u3 ON u3.target = n.id WHERE n.type = 'SIM' AND coalesce(d2.p, u3.p) IS NOT NULL"""
MONEY = """SELECT 'C1' AS source, target, path, 2::BIGINT AS length, row_number() OVER (PARTITION BY target ORDER BY hop) AS rank FROM (
  SELECT s.dst AS target, c.dst AS hop, 'C1>' || c.dst || '>' || s.dst AS path FROM edges c JOIN edges s ON s.src = c.dst AND s.dst LIKE 'N%' WHERE c.src = 'C1' AND c.rel = 'TRANSFERRED_TO') QUALIFY rank <= 10"""
MONEY_WHOLE = """SELECT source, target, path, 2::BIGINT AS length, rank FROM (SELECT c.src AS source, s.dst AS target, c.src || '>' || c.dst || '>' || s.dst AS path,
  row_number() OVER (PARTITION BY c.src, s.dst ORDER BY c.dst) AS rank FROM edges c JOIN edges s ON s.src = c.dst AND s.dst LIKE 'N%' WHERE c.rel = 'TRANSFERRED_TO') WHERE rank <= 10"""
# All simple paths of one to three hops; a pair whose first ten are not all among them has fewer, or needs the fourth.
MONEY_ACCOUNTS = """arc AS MATERIALIZED (SELECT DISTINCT src, dst FROM transfers WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
near AS (SELECT DISTINCT description, floor(amount / 10) AS tens, src, dst FROM transfers WHERE src IS NOT NULL AND dst IS NOT NULL),
pair AS MATERIALIZED (SELECT DISTINCT a.src AS source, b.dst AS target FROM near a JOIN near b ON a.description = b.description AND a.tens = b.tens WHERE a.src <> b.dst),
p1 AS (SELECT source, target, [source, target] AS path FROM pair JOIN arc ON src = source AND dst = target),
p2 AS (SELECT source, target, [source, a.dst, target] AS path FROM pair JOIN arc a ON a.src = source JOIN arc b ON b.src = a.dst AND b.dst = target WHERE a.dst <> target),
few AS (SELECT source, target FROM pair LEFT JOIN (SELECT source, target, count(*) AS n FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY 1, 2) k USING (source, target) WHERE coalesce(n, 0) < 10),
p3 AS (SELECT source, target, [source, a.dst, b.dst, target] AS path FROM few JOIN arc a ON a.src = source JOIN arc b ON b.src = a.dst JOIN arc c ON c.src = b.dst AND c.dst = target
  WHERE a.dst <> target AND b.dst <> target AND b.dst <> source),
few3 AS (SELECT source, target FROM few LEFT JOIN (SELECT source, target, count(*) AS n FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY 1, 2) k USING (source, target) WHERE coalesce(n, 0) < 10),
p4 AS (SELECT source, target, [source, a.dst, b.dst, c.dst, target] AS path FROM few3 JOIN arc a ON a.src = source JOIN arc b ON b.src = a.dst JOIN arc c ON c.src = b.dst JOIN arc e ON e.src = c.dst AND e.dst = target
  WHERE a.dst <> target AND b.dst <> target AND c.dst <> target AND b.dst <> source AND c.dst <> source AND c.dst <> a.dst)
SELECT source, target, array_to_string(path, '>') AS path, (len(path) - 1)::BIGINT AS length, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY len(path), path) AS rank
  FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)) WHERE rank <= 10"""
# No path here is longer than four hops along edges in either direction; directed ones have two at most.
SHORTEST_WHOLE = """pair AS MATERIALIZED (SELECT DISTINCT 'C' || o_custkey AS source, unnest(['C' || (o_orderkey % (SELECT count(*) FROM customer) + 1), 'N' || (o_orderkey % 25)]) AS target FROM orders),
known AS MATERIALIZED (SELECT * FROM pair WHERE source <> target AND source IN (SELECT id FROM both_ways) AND target IN (SELECT id FROM both_ways)),
nb AS MATERIALIZED (SELECT DISTINCT id, nbr FROM both_ways),
one AS (SELECT source, target, [source, target] AS path, true AS directed FROM known WHERE EXISTS (SELECT 1 FROM edges WHERE src = source AND dst = target)),
two AS (SELECT source, target, min([source, a.dst, target]) AS path, true AS directed FROM known JOIN edges a ON a.src = source JOIN edges b ON b.src = a.dst AND b.dst = target GROUP BY 1, 2),
dir AS MATERIALIZED (SELECT * FROM one UNION ALL SELECT * FROM two WHERE (source, target) NOT IN (SELECT (source, target) FROM one)),
rest AS MATERIALIZED (SELECT * FROM known WHERE (source, target) NOT IN (SELECT (source, target) FROM dir)),
u2 AS MATERIALIZED (SELECT source, target, min([source, a.nbr, target]) AS path FROM rest JOIN nb a ON a.id = source JOIN nb b ON b.id = target AND b.nbr = a.nbr GROUP BY 1, 2),
rest2 AS MATERIALIZED (SELECT * FROM rest WHERE (source, target) NOT IN (SELECT (source, target) FROM u2)),
far AS MATERIALIZED (SELECT source, m, min(x) AS x FROM (SELECT DISTINCT source FROM rest2) JOIN (SELECT a.id, a.nbr AS x, b.nbr AS m FROM nb a JOIN nb b ON b.id = a.nbr) ON id = source GROUP BY 1, 2),
u3 AS MATERIALIZED (SELECT source, target, min([source, x, m, target]) AS path FROM rest2 JOIN nb ON id = target JOIN far USING (source) WHERE m = nbr GROUP BY 1, 2),
rest3 AS MATERIALIZED (SELECT * FROM rest2 WHERE (source, target) NOT IN (SELECT (source, target) FROM u3)),
back AS MATERIALIZED (SELECT target, m, min(y) AS y FROM (SELECT DISTINCT target FROM rest3) JOIN (SELECT a.id, a.nbr AS y, b.nbr AS m FROM nb a JOIN nb b ON b.id = a.nbr) ON id = target GROUP BY 1, 2),
u4 AS (SELECT source, target, min([source, x, m, y, target]) AS path FROM rest3 JOIN far USING (source) JOIN back USING (target, m) GROUP BY 1, 2)
SELECT source, target, array_to_string(path, '>') AS path, (len(path) - 1)::BIGINT AS length, directed
FROM (SELECT source, target, [source] AS path, true AS directed FROM pair WHERE source = target UNION ALL SELECT * FROM dir UNION ALL SELECT *, false FROM u2 UNION ALL SELECT *, false FROM u3 UNION ALL SELECT *, false FROM u4)"""
COMPONENTS = "SELECT id, CASE WHEN type = 'PERSON' THEN min(id) OVER (PARTITION BY nation) WHEN type = 'SIM' THEN min(id) OVER (PARTITION BY nation) ELSE id END AS component FROM (SELECT v.id, v.type, coalesce(e.dst, v.id) AS nation FROM vertices v LEFT JOIN edges e ON e.src = v.id AND e.rel = 'USES')"


def _ranks(rounds: int) -> str:
    steps = ["n AS (SELECT count(*)::DOUBLE AS n FROM vertices)", "o AS (SELECT src, count(*) AS o FROM (SELECT DISTINCT src, dst FROM edges) GROUP BY src)", "r0 AS (SELECT v.id, o.o, 1.0::DOUBLE / n.n AS rank FROM vertices v CROSS JOIN n LEFT JOIN o ON o.src = v.id)"]
    for k in range(rounds):
        steps.append(f"g{k} AS (SELECT e.dst AS id, sum(r.rank / r.o) AS got FROM (SELECT DISTINCT src, dst FROM edges) e JOIN r{k} r ON r.id = e.src GROUP BY e.dst)")
        steps.append(f"s{k} AS (SELECT r.id, r.o, 0.15 / n.n + 0.85 * ((SELECT coalesce(sum(rank), 0.0) FROM r{k} WHERE o IS NULL) / n.n + coalesce(g.got, 0.0)) AS rank FROM r{k} r CROSS JOIN n LEFT JOIN g{k} g ON g.id = r.id)")
        steps.append(f"r{k + 1} AS (SELECT id, o, rank / (SELECT sum(rank) FROM s{k}) AS rank FROM s{k})")
    return ", ".join(steps) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


# In a star forest only the hub lies between its leaves.
BETWEEN = """k AS (SELECT dst AS id, count(*)::DOUBLE AS k FROM memberships GROUP BY dst), n AS (SELECT count(*)::DOUBLE AS n FROM vertices)
SELECT v.id, round(coalesce(k * (k - 1), 0.0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM vertices v CROSS JOIN n LEFT JOIN k ON k.id = v.id"""
VE = ("vertices", "edges")


def _least_labels(rounds: int) -> str:
    """The least id within so many edges: that of the component where no path is longer."""
    steps = ["l0 AS (SELECT id, id AS c FROM vertices)"]
    steps += [f"l{k + 1} AS MATERIALIZED (SELECT l.id, least(l.c, coalesce(n.c, l.c)) AS c FROM l{k} l LEFT JOIN (SELECT b.id, min(o.c) AS c FROM both_ways b JOIN l{k} o ON o.id = b.nbr GROUP BY b.id) n ON n.id = l.id)" for k in range(rounds)]
    return ", ".join(steps)


WHOLE = f", {BOTH}, {_least_labels(9)}"
# Every customer and supplier has one nation.
NATIONS = "en AS (SELECT src, dst FROM edges WHERE dst LIKE 'N%'), cn AS (SELECT v.id, min(v.id) OVER (PARTITION BY coalesce(e.dst, v.id)) AS component FROM vertices v LEFT JOIN en e ON e.src = v.id)"
# In a star only the hub lies between its leaves; its rank and theirs come from three rounds.
STARS = f"""{VOLUMES}, sv AS (SELECT * FROM vertices WHERE type <> 'DEVICE'), se AS (SELECT * FROM edges WHERE dst LIKE 'N%'), nn AS (SELECT count(*)::DOUBLE AS n FROM sv),
sb AS (SELECT id, src AS nbr FROM (SELECT dst AS id, src FROM se) UNION ALL SELECT src, dst FROM se),
sd AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(*) AS degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM se UNION ALL SELECT dst, 1, 0 FROM se) GROUP BY id),
sy AS (SELECT b.id, count(*) FILTER (v.type = 'BANK_ACCOUNT') AS accounts, count(*) FILTER (v.type = 'DEVICE') AS devices, count(*) FILTER (v.type = 'SIM') AS sims FROM sb b JOIN sv v ON v.id = b.nbr GROUP BY b.id),
{_ranks(3).replace('edges', 'se').replace('vertices', 'sv').rsplit(' SELECT', 1)[0]},
sx AS (SELECT vol.*, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(accounts, 0) AS accounts, coalesce(devices, 0) AS devices, coalesce(sims, 0) AS sims, r3.rank AS rank,
  CASE WHEN vol.type = 'SIM' THEN coalesce(in_degree * (in_degree - 1), 0) / ((nn.n - 1) * (nn.n - 2)) ELSE 0.0::DOUBLE END AS bc FROM vol JOIN sv ON sv.id = vol.id CROSS JOIN nn LEFT JOIN sd ON sd.id = vol.id LEFT JOIN sy ON sy.id = vol.id LEFT JOIN r3 ON r3.id = vol.id),
sc AS (SELECT *, round(0.35 * {sig('bc', 0.1, 15)} + 0.30 * {sig('rank', 0.05, 20)} + 0.20 * {sig('out_degree', 5, 0.4)} + 0.15 * {sig('calls_out', 5, 0.3)}, 4) AS coordinator,
  round(0.30 * {sig('bc', 0.05, 12)} + 0.30 * {sig('degree', 4, 0.5)} + 0.25 * least(in_degree, out_degree) / greatest(in_degree, out_degree, 1)::DOUBLE + 0.15 * {sig('fwd', 0.5, 4)}, 4) AS intermediary,
  round(CASE WHEN type = 'BANK_ACCOUNT' OR (received > 0 AND forwarded > 0) THEN 0.5 * {sig('fwd', 0.8, 8)} + 0.3 * {sig('n_in', 3, 0.8)} + 0.2 * (1 - {sig('degree', 6, 0.5)}) ELSE 0.0 END, 4) AS mule,
  round(CASE WHEN type IN ('DEVICE', 'SIM') THEN 0.7 * {sig('accounts + devices + sims + degree', 3, 0.7)} + 0.3 * {sig('degree', 4, 0.5)} ELSE 0.0 END, 4) AS technical,
  round(least((CASE WHEN coalesce(risk, 0) < 0.3 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN in_degree > 0 AND out_degree = 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN received > 0 AND forwarded = 0 THEN 0.2::DOUBLE ELSE 0 END), 0.8), 4) AS victim FROM sx),
su AS (SELECT *, round(greatest(0.0::DOUBLE, 0.4 - 0.4 * greatest(coordinator, intermediary, mule, technical, victim)), 4) AS unknown FROM sc),
ro AS (SELECT *, greatest(coordinator, intermediary, mule, technical, victim, unknown) AS best FROM su),
assigned AS (SELECT *, CASE best WHEN coordinator THEN 'Potential Coordinator' WHEN intermediary THEN 'Potential Intermediary' WHEN mule THEN 'Potential Mule Account' WHEN technical THEN 'Technical/Device Node' WHEN victim THEN 'Victim' ELSE 'Unknown' END AS primary_role FROM ro)"""
ASSIGNED = """ SELECT id, round(coordinator, 3) AS coordinator, round(intermediary, 3) AS intermediary, round(mule, 3) AS mule, round(technical, 3) AS technical, round(victim, 3) AS victim, round(unknown, 3) AS unknown, primary_role,
  ((bc > 0.05)::INT + (rank > 0.01)::INT + (received + forwarded > 0)::INT + (fwd > 0)::INT + (accounts > 0)::INT + (devices > 0)::INT + (sims > 0)::INT + (calls_in + calls_out > 0)::INT)::INTEGER AS n_evidence, true AS explained FROM assigned"""

QUERIES = {
    "hub_edges": hub_edges, "sim_swap": sim_swap, "shared_device": shared_device, "shared_sim": shared_sim, "triangles": triangles, "dense_clusters": dense_clusters, "findings_all": findings_all, "analysis": analysis,
    "findings_whole": findings_all, "analysis_whole": analysis, "analysis_stored": analysis_stored, "roles_assigned": roles_assigned, "roles_stored": roles_stored, "roles_whole": roles_whole, "betweenness_whole": betweenness_whole,
    "graph_filter": graph_filter, "graph_build": graph_build, "ego2": ego2, "shortest_path": shortest_path, "money_paths": money_paths, "money_paths_whole": money_paths_whole, "money_paths_accounts": money_paths_accounts, "shortest_paths_whole": shortest_paths_whole, "components": components, "component_sizes": component_sizes,
    "components_whole": components_whole, "component_sizes_whole": component_sizes_whole, "pagerank_whole": pagerank_whole, "component_graphs": component_graphs, "component_graphs_of_nations": component_graphs_of_nations,
    "search": search, "node_detail": node_detail, "degree": degree, "typed_nbrs": typed_nbrs, "pagerank3": pagerank3, "betweenness_small": betweenness_small, "role_volumes": role_volumes, "roles_local": roles_local,
}
ORACLES = {
    "hub_edges": with_views(HUBE, *VE), "sim_swap": _supplier_transfers(f", {SWAP}", *VE), "shared_device": with_views(f", {BOTH} {DEV}", *VE), "shared_sim": with_views(f", {BOTH} {SIM}", *VE),
    "triangles": with_views(f", {TRI} SELECT a || '>' || b || '>' || c AS members FROM tri", "edges"), "dense_clusters": with_views(f", {TRI}, {DENSE}", *VE),
    "graph_filter": with_views("SELECT * FROM edges WHERE rel = 'TRANSFERRED_TO'", "edges"),
    "graph_build": with_views("SELECT src, dst, CASE WHEN rel = 'USES' THEN 'OWNS' ELSE rel END AS rel, confidence FROM edges WHERE src NOT LIKE 'P%'", "edges"),
    "ego2": with_views(f", {BOTH}, lk AS (SELECT id, nbr FROM both_ways WHERE rel IN ('USES', 'LINKED_TO')) {EGO}", *VE),
    "shortest_path": with_views(f", {BOTH}{SHORTEST}", *VE), "money_paths": with_views(MONEY, "edges"), "money_paths_whole": with_views(MONEY_WHOLE, "edges"), "money_paths_accounts": with_views(f", {MONEY_ACCOUNTS}", "transfers"),
    "shortest_paths_whole": with_views(f", {BOTH}, {SHORTEST_WHOLE}", "edges"), "components": with_views(COMPONENTS, *VE),
    "component_sizes": with_views(f", c AS ({COMPONENTS}) SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS index FROM c GROUP BY component", *VE),
    "components_whole": with_views(f"{WHOLE} SELECT id, c AS component FROM l9", *VE),
    "component_sizes_whole": with_views(f"{WHOLE} SELECT c AS component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS index FROM l9 GROUP BY c", *VE),
    "roles_assigned": _supplier_transfers(f", {STARS}{ASSIGNED}", "calls", *VE),
    "roles_stored": _supplier_transfers(f", {STARS} SELECT 'c1' AS case_id, primary_role, count(*) AS n FROM assigned GROUP BY 1, 2", "calls", *VE),
    "search": with_views("SELECT id, type, label FROM vertices WHERE contains(lower(label), 'ation') OR contains(lower(id), 'ation')", "vertices"),
    "node_detail": with_views(
        f""", {BOTH}, {DEGREE}, nb AS (SELECT id, count(DISTINCT nbr) FILTER (nbr <> id) AS neighbours, count(*) FILTER (rel IN ('TRANSFERRED_TO', 'PAID_TO')) AS money_edges FROM both_ways GROUP BY id)
SELECT v.id, v.type, v.label, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(neighbours, 0) AS neighbours, coalesce(money_edges, 0) AS money_edges
FROM vertices v LEFT JOIN dg USING (id) LEFT JOIN nb USING (id)""", *VE),
    "degree": with_views(f", {DEGREE} SELECT * FROM dg", "edges"), "typed_nbrs": with_views(f", {BOTH}, {TYPED} SELECT * FROM ty", *VE),
    "pagerank3": with_views(f", {_ranks(3)}", *VE), "betweenness_small": with_views(f", {BETWEEN}", "vertices", "memberships"),
    "role_volumes": _supplier_transfers(f", {VOLUMES} SELECT id, received, n_in, forwarded, n_out, calls_in, calls_out, round(fwd, 6) AS fwd FROM vol WHERE type = 'BANK_ACCOUNT'", "calls", "vertices"),
    "roles_local": _supplier_transfers(f", {ROLES}", "calls", *VE),
}
ORACLES = {k: v.replace(") , ", "), ") for k, v in ORACLES.items()}
_SUBJECT = {"velocity": "account", "mule": "account", "comm_hub": "caller", "rapid_hop": "concat_ws('>', a, b, c, d)", "dense_cluster": "members", "layering": "concat_ws('>', a, b, c, d)"}
_FOUND = {"sim_swap": ORACLES["sim_swap"], "mule": MULE, "rapid_hop": RAPID, "shared_device": ORACLES["shared_device"], "shared_sim": ORACLES["shared_sim"], "velocity": VELOCITY, "comm_hub": HUB, "hub_edges": ORACLES["hub_edges"], "dense_cluster": ORACLES["dense_clusters"], "layering": LAYERING}
_FOUND = {k: v.replace(") , ", "), ") for k, v in _FOUND.items()}
ORACLES["findings_all"] = " UNION ALL ".join(f"SELECT 'c1' AS case_id, '{k}' AS pattern, {_SUBJECT.get(k, 'id')} AS subject, score, confidence FROM ({v})" for k, v in _FOUND.items())
ORACLES["analysis"] = f"""WITH f AS ({ORACLES['findings_all']}), p AS (SELECT case_id, pattern, count(*) AS n, max(score) AS top FROM f GROUP BY 1, 2)
SELECT case_id, sum(n)::BIGINT AS total, max(top) AS top_score, string_agg(pattern || '=' || n, ',' ORDER BY pattern) AS by_pattern FROM p GROUP BY case_id"""
ORACLES["findings_whole"], ORACLES["analysis_whole"] = ORACLES["findings_all"], ORACLES["analysis"]
ORACLES["analysis_stored"] = f"""WITH r AS ({ORACLES['analysis']}) SELECT case_id, total, top_score, by_pattern FROM r UNION ALL SELECT 'c2', 0, top_score, by_pattern FROM r"""
ORACLES["component_graphs"] = with_views(f", {NATIONS} SELECT component, count(*) AS n_vertices, count(src) AS n_edges, min(src) AS first_src, max(src) AS last_src FROM cn LEFT JOIN en ON src = id GROUP BY component", *VE)
ORACLES["component_graphs_of_nations"] = with_views(
    f""", {NATIONS} SELECT component, id, (SELECT count(*) FROM en WHERE dst = cn.id) AS in_degree, (SELECT count(*) FROM en WHERE src = cn.id) AS out_degree, count(*) OVER (PARTITION BY component) AS size
FROM cn WHERE component IN (SELECT component FROM cn WHERE id LIKE 'N%')""", *VE)
