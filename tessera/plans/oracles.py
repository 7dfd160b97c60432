"""SQL that computes the registered queries from the driver's tables, written apart from the DataFrame code."""

from __future__ import annotations

NODES = """nodes AS (
  SELECT 'REGION:' || r_regionkey AS id, 'kg:Region' AS category, r_name AS name, NULL::VARCHAR AS synonym, NULL::VARCHAR AS description, NULL::VARCHAR AS in_taxon_label, NULL::VARCHAR AS deprecated FROM region
  UNION ALL SELECT 'NATION:' || n_nationkey, 'kg:Nation', n_name, '[' || lower(n_name) || ', N' || n_nationkey || ']', NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'CUST:' || c_custkey, 'kg:Customer', CASE WHEN c_custkey % 37 <> 0 THEN c_name END, '[' || c_mktsegment || ']', NULL, NULL, CASE WHEN c_custkey % 29 = 0 THEN 'True' END FROM customer
  UNION ALL SELECT 'SUPP:' || s_suppkey, 'kg:Supplier', s_name, NULL, NULL, CASE s_suppkey % 4 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'Mus musculus' END, CASE WHEN s_suppkey % 13 = 0 THEN 'True' END FROM supplier
  UNION ALL SELECT 'PART:' || p_partkey, 'kg:Part', p_name, '[' || p_brand || ', ''' || p_brand || ', ' || p_type || ''']', CASE WHEN p_partkey % 3 = 0 THEN p_type || ' ' || p_brand END, NULL, NULL FROM part
  UNION ALL SELECT 'ORD:' || o_orderkey, 'kg:Order', CASE WHEN o_orderkey % 41 <> 0 THEN 'Order ' || o_orderkey END, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 97 <> 0
)"""
EDGES = """edges AS (
  SELECT 'NATION:' || n_nationkey AS subject, 'REGION:' || n_regionkey AS object, 'kg:part_of' AS predicate, NULL::VARCHAR AS knowledge_level, NULL::VARCHAR AS agent_type, NULL::VARCHAR AS primary_knowledge_source FROM nation
  UNION ALL SELECT 'CUST:' || c_custkey, 'NATION:' || c_nationkey, 'kg:located_in', NULL, NULL, NULL FROM customer
  UNION ALL SELECT 'SUPP:' || s_suppkey, 'NATION:' || s_nationkey, 'kg:located_in', NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'ORD:' || o_orderkey, 'CUST:' || o_custkey, 'kg:placed_by', NULL, NULL, o_orderpriority FROM orders
  UNION ALL SELECT 'ORD:' || l_orderkey, 'PART:' || l_partkey, 'kg:contains', l_returnflag, l_linestatus, NULL FROM lineitem
  UNION ALL SELECT 'SUPP:' || l_suppkey, 'PART:' || l_partkey, 'kg:supplies', l_returnflag, l_linestatus, NULL FROM lineitem
)"""
GRAPH = f"{NODES}, {EDGES}"
ENDS = "ends AS (SELECT subject AS id, object AS other FROM edges UNION ALL SELECT object, subject FROM edges)"
DEGREE = f"{ENDS}, degree AS (SELECT id, count(*) AS deg FROM ends GROUP BY id)"
SEEDS = """seeds AS (
  SELECT DISTINCT id FROM nodes WHERE id LIKE 'SUPP:%' AND (name LIKE '%#00000000%' OR name LIKE '%7%' OR name LIKE '%no such name%') AND deprecated IS NULL
)"""
ALLOWED = "('CUST', 'SUPP', 'PART', 'ORD', 'NATION')"
CUT = f"""kept_edges AS (
  SELECT e.* FROM edges e JOIN nodes s ON s.id = e.subject JOIN nodes o ON o.id = e.object
  WHERE split_part(e.subject, ':', 1) IN {ALLOWED} AND split_part(e.object, ':', 1) IN {ALLOWED}
    AND coalesce(s.in_taxon_label, 'Homo sapiens') = 'Homo sapiens' AND coalesce(o.in_taxon_label, 'Homo sapiens') = 'Homo sapiens'
), kept_nodes AS (
  SELECT * FROM nodes WHERE id IN (SELECT subject FROM kept_edges UNION SELECT object FROM kept_edges)
)"""
INDUCED = "(subject IN (SELECT id FROM {0}) AND object IN (SELECT id FROM {0}))"
INCIDENT = "(subject IN (SELECT id FROM {0}) OR object IN (SELECT id FROM {0}))"
#: Ends of edges on seeds, with the seeds themselves or without those that have no edge.
H1 = f"{ENDS}, h1 AS MATERIALIZED (SELECT id FROM seeds UNION SELECT e.other FROM ends e SEMI JOIN seeds s ON s.id = e.id)"
FRONTIER = "frontier AS (SELECT DISTINCT unnest([e.id, e.other]) AS id FROM ends e SEMI JOIN seeds s ON s.id = e.id)"
ALIVE = "alive AS (SELECT * FROM nodes WHERE id LIKE 'SUPP:%' AND (deprecated IS NULL OR deprecated = ''))"
#: Neighbours with the number of edges to them; an end's edges are the sum over its neighbours.
SHAPE = f"""{ENDS}, {ALIVE}, links AS (SELECT id, other, count(*) AS edges_between FROM ends GROUP BY id, other), totals AS (SELECT id, sum(edges_between) AS weight FROM links GROUP BY id),
around AS (
  SELECT l.id, count(*) AS h1_nodes, CAST(sum(t.weight) AS BIGINT) AS h2_edges_ub FROM links l SEMI JOIN alive a ON a.id = l.id JOIN totals t ON t.id = l.other GROUP BY l.id
)"""
VECTORS = """vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS embedding, CASE WHEN vec_id % 5 = 0 AND vec_id // 5 IN (SELECT s_suppkey FROM supplier) THEN 'SUPP:' || (vec_id // 5)
         WHEN vec_id IN (SELECT p_partkey FROM part) THEN 'PART:' || vec_id END AS id FROM embeddings
), gallery AS (SELECT id, embedding FROM vectors WHERE id IS NOT NULL)"""
DESCRIBED = "['kg:supplies', 'kg:contains', 'kg:placed_by', 'kg:located_in', 'kg:part_of']"
SCORES = f"""described AS (
  SELECT label AS position, {DESCRIBED}[label + 1] AS predicate, list(x ORDER BY i) AS embedding FROM (
    SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label < 5) GROUP BY label, i
  ) GROUP BY label
), asked AS (SELECT vec_id AS question_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"""
SCORED = """scores AS (
  SELECT question_id, label, predicate, position, round(list_cosine_similarity(a.embedding, d.embedding), 6) AS score FROM asked a CROSS JOIN described d
), chosen AS (
  SELECT question_id, predicate, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, position)::INTEGER AS predicate_rank
  FROM (SELECT *, max(score) OVER (PARTITION BY question_id) AS best FROM scores) WHERE score >= best - 0.05
)"""
ADJACENT = """adjacent AS (
  SELECT subject AS node, predicate, object AS other, 'out' AS dir FROM edges UNION ALL SELECT object, predicate, subject, 'in' FROM edges WHERE subject <> object
)"""
CRAWL = f"""{SCORED}, candidates AS (
  SELECT question_id, id, sim, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id)::INTEGER AS rank
  FROM (SELECT question_id, g.id, round(list_cosine_similarity(a.embedding, g.embedding), 6) AS sim FROM asked a CROSS JOIN gallery g) QUALIFY rank <= 25
), {ADJACENT}, tallied AS (SELECT node, predicate, count(*) AS n FROM adjacent GROUP BY ALL),
counted AS (
  SELECT c.question_id, c.id, c.rank, coalesce(sum(t.n), 0)::BIGINT AS n_edges FROM candidates c JOIN chosen p USING (question_id)
  LEFT JOIN tallied t ON t.node = c.id AND t.predicate = p.predicate GROUP BY ALL
), found AS (
  SELECT question_id, id AS anchor, rank, n_edges FROM counted
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN id LIKE 'SUPP:%' AND n_edges > 0 THEN 0 WHEN id LIKE 'SUPP:%' THEN 1 ELSE 2 END, rank) = 1
), facts AS (
  SELECT f.question_id, f.anchor, c.predicate, c.predicate_rank, a.other AS other_id, n.category, n.name, a.dir
  FROM found f JOIN chosen c USING (question_id) JOIN adjacent a ON a.node = f.anchor AND a.predicate = c.predicate LEFT JOIN nodes n ON n.id = a.other
)"""


def _gold(kind: str, template: str, anchor: str, answer: str, predicate: str, prefix: str, answer_ns: str, least: int) -> str:
    return f"""{kind}_told AS (
  SELECT DISTINCT a.id AS anchor, a.name, e.{answer} AS answer FROM alive_named a JOIN edges e ON e.{anchor} = a.id
  WHERE split_part(a.id, ':', 1) = '{prefix}' AND e.predicate = '{predicate}' AND split_part(e.{answer}, ':', 1) = '{answer_ns}'
), {kind}_counted AS (SELECT *, count(*) OVER (PARTITION BY anchor) AS n_answers FROM {kind}_told),
{kind} AS (
  SELECT '{kind}-' || anchor AS id, '{kind}' AS type, replace('{template}', '{{disease}}', name) AS question, anchor, answer, n_answers
  FROM {kind}_counted WHERE n_answers >= {least} QUALIFY dense_rank() OVER (ORDER BY md5(anchor || '13'), anchor) <= 60
)"""


NAMED = "alive_named AS (SELECT id, name FROM nodes WHERE coalesce(name, '') <> '' AND coalesce(deprecated, '') = '')"
SUPPLIER_GOLD = ", ".join((
    NAMED,
    _gold("supplied", "What does {disease} supply?", "subject", "object", "kg:supplies", "SUPP", "PART", 5),
    _gold("seat", "Where is {disease}?", "subject", "object", "kg:located_in", "SUPP", "NATION", 1),
))
CUSTOMER_GOLD = _gold("ordered", "What did {disease} order?", "object", "subject", "kg:placed_by", "CUST", "ORD", 3)
GOLD = f"{SUPPLIER_GOLD}, {CUSTOMER_GOLD}, gold AS (SELECT * FROM supplied UNION ALL SELECT * FROM seat UNION ALL SELECT * FROM ordered)"
HALF_GOLD = f"{SUPPLIER_GOLD}, gold AS (SELECT * FROM supplied UNION ALL SELECT * FROM seat)"
SCORE = """, scored AS (
  SELECT g.id, g.type, count(h.hit)::DOUBLE / count(*) AS recall, max(CASE WHEN a.hit IS NOT NULL THEN 1.0 ELSE 0.0 END) AS anchor_hit
  FROM gold g LEFT JOIN hits h ON h.id = g.id AND h.hit = g.answer LEFT JOIN hits a ON a.id = g.id AND a.hit = g.anchor GROUP BY g.id, g.type
), types(type) AS (VALUES ('supplied'), ('seat'), ('overall'))
SELECT t.type, count(s.id) AS n, coalesce(round(avg(s.recall), 6), 0.0) AS recall, coalesce(round(avg(s.anchor_hit), 6), 0.0)::DOUBLE AS anchor_hit
FROM types t LEFT JOIN scored s ON t.type = s.type OR t.type = 'overall' GROUP BY t.type
"""
GOLD_ASKED = "asked AS (SELECT DISTINCT g.id AS question_id, v.embedding FROM gold g JOIN gallery v ON v.id = g.anchor)"
RANKS = f"""{VECTORS}, asked AS (SELECT vec_id AS question_id, embedding::DOUBLE[] AS embedding, 'PART:' || (vec_id + 1) AS target FROM embeddings),
goals AS (SELECT a.*, round(list_cosine_similarity(a.embedding, g.embedding), 6) AS goal FROM asked a JOIN gallery g ON g.id = a.target),
ranks AS (SELECT question_id, target, 1 + count(*) FILTER (WHERE round(list_cosine_similarity(x.embedding, g.embedding), 6) > goal) AS rank FROM goals x CROSS JOIN gallery g GROUP BY question_id, target)"""
QUALITY = "count(*) AS n, round(avg(1.0 / rank), 6) AS mrr, round(avg((rank <= 1)::INTEGER), 6) AS recall_at_1, round(avg((rank <= 5)::INTEGER), 6) AS recall_at_5, round(avg((rank <= 10)::INTEGER), 6) AS recall_at_10"
SYNONYMS = """listed AS (
  SELECT id, name, split_part(id, ':', 1) AS ns, CASE WHEN id LIKE 'NATION:%' THEN 'N' || split_part(id, ':', 2) ELSE trim(string_split(substr(synonym, 2, length(synonym) - 2), ',')[1]) END AS query
  FROM nodes WHERE name IS NOT NULL AND name <> '' AND synonym IS NOT NULL AND synonym <> ''
), queries AS (
  SELECT query, id AS target, ns FROM (SELECT * FROM listed ORDER BY md5(id || '7'), id LIMIT 1500) ORDER BY md5(id || '7'), id LIMIT 500
)"""


def _breakdown(table: str, expression: str) -> str:
    return f"""WITH {GRAPH}, counts AS (SELECT coalesce({expression}, '(none)') AS bucket, count(*) AS n FROM {table} GROUP BY 1),
shown AS (SELECT * FROM counts ORDER BY n DESC, bucket LIMIT 15), total AS (SELECT sum(n)::BIGINT AS total FROM counts),
every AS (SELECT * FROM shown UNION ALL SELECT '(rest)', (total - (SELECT sum(n) FROM shown))::BIGINT FROM total WHERE total > (SELECT sum(n) FROM shown))
SELECT bucket, n, round(100.0 * n / total, 6)::DOUBLE AS pct FROM every, total"""


def _relevance_cuts() -> str:
    """Each scenario drops what the one before dropped and more, so an edge has a depth: the last scenario that keeps it."""
    human = " AND ".join(f"coalesce({x}.in_taxon_label, 'Homo sapiens') = 'Homo sapiens'" for x in "so")
    return f"""WITH {GRAPH}, {ALIVE}, cuts(no, label) AS (VALUES (0, 'whole graph'), (1, 'drop non-human'), (2, '+ drop contains and part_of'), (3, '+ drop nations')),
deep AS MATERIALIZED (
  SELECT subject, object, CASE WHEN NOT ({human}) THEN 0 WHEN predicate IN ('kg:contains', 'kg:part_of') THEN 1 WHEN 'kg:Nation' IN (s.category, o.category) THEN 2 ELSE 3 END AS depth
  FROM edges JOIN nodes s ON s.id = subject JOIN nodes o ON o.id = object
), deepest AS (SELECT id, max(depth) AS depth FROM (SELECT unnest([subject, object]) AS id, depth FROM deep) GROUP BY id),
by_node AS (SELECT no, label, count(*) AS nodes, count(alive.id) AS anchors FROM cuts JOIN deepest ON depth >= no LEFT JOIN alive ON alive.id = deepest.id GROUP BY no, label),
by_edge AS (SELECT no, count(*) AS triples FROM cuts JOIN deep ON depth >= no GROUP BY no)
SELECT label, nodes, triples, anchors, round(100.0 * anchors / (SELECT count(*) FROM alive), 6)::DOUBLE AS pct_anchors FROM by_node JOIN by_edge USING (no)"""


#: Hop of each node from a scenario's start (0 to 2), and its edges with the hops of both ends; scenarios are named by `label`.
LABELLED = """steps AS (SELECT label, subject AS id, object AS other FROM live UNION ALL SELECT label, object, subject FROM live),
one AS (SELECT label, id, 0 AS hop FROM start UNION ALL SELECT s.label, s.other, 1 FROM steps s JOIN start USING (label, id)),
within_one AS (SELECT label, id, min(hop) AS hop FROM one GROUP BY ALL),
two AS (SELECT * FROM within_one UNION ALL SELECT s.label, s.other, w.hop + 1 FROM steps s JOIN within_one w USING (label, id)),
hops AS MATERIALIZED (SELECT label, id, min(hop) AS hop FROM two GROUP BY ALL),
met AS (
  SELECT l.label, least(coalesce(a.hop, 9), coalesce(b.hop, 9)) AS nearer, greatest(coalesce(a.hop, 9), coalesce(b.hop, 9)) AS farther
  FROM live l LEFT JOIN hops a ON a.label = l.label AND a.id = l.subject LEFT JOIN hops b ON b.label = l.label AND b.id = l.object
),
sizes AS (SELECT label, count(*) FILTER (WHERE hop = 0) AS at_start, count(*) FILTER (WHERE hop <= 1) AS in_one, count(*) AS in_two FROM hops GROUP BY label),
counts AS (
  SELECT label, count(*) FILTER (WHERE nearer = 0) AS on_start, count(*) FILTER (WHERE nearer <= 1) AS on_one, count(*) FILTER (WHERE farther <= 1) AS inside_one, count(*) FILTER (WHERE farther <= 2) AS inside_two
  FROM met GROUP BY label
)"""


def _predicate_cuts() -> str:
    return f"""WITH {GRAPH}, {SEEDS}, scenarios(label, dropped) AS (VALUES ('none (baseline)', []::VARCHAR[]), ('drop located_in', ['kg:located_in']), ('drop located_in + contains', ['kg:located_in', 'kg:contains'])),
live AS (SELECT label, subject, object FROM edges, scenarios WHERE NOT list_contains(dropped, predicate)), start AS (SELECT label, id FROM scenarios, seeds), {LABELLED}
SELECT label, in_one AS h1_nodes, on_start AS h1_edges, in_two AS h2_nodes, on_one AS h2_edges FROM sizes JOIN counts USING (label)"""


def _pattern_shapes() -> str:
    return f"""WITH {GRAPH}, {DEGREE}, {ALIVE}, scenarios(label) AS (VALUES ('#00000000'), ('7'), ('no such name')),
live AS (SELECT label, subject, object FROM edges, scenarios), start AS (SELECT label, id FROM scenarios, alive WHERE contains(lower(name), label)), {LABELLED},
largest AS (
  SELECT h.label, coalesce(nullif(n.name, ''), n.id) AS hub, d.deg FROM hops h JOIN degree d USING (id) JOIN nodes n USING (id) WHERE h.hop <= 1
  QUALIFY row_number() OVER (PARTITION BY h.label ORDER BY d.deg DESC, n.id DESC) = 1
)
SELECT s.label AS pattern, coalesce(z.at_start, 0) AS seeds, coalesce(z.in_one, 0) AS h1_nodes, c.inside_one AS h1_induced, coalesce(z.in_two, 0) AS h2_nodes, c.inside_two AS h2_induced, c.on_one AS h2_incident,
  l.hub AS top_hub, l.deg AS top_hub_deg FROM scenarios s LEFT JOIN sizes z USING (label) LEFT JOIN counts c USING (label) LEFT JOIN largest l USING (label)"""


SUBSETS = f"""{ALIVE}, {SEEDS}, {H1}, h2 AS MATERIALIZED (SELECT id FROM h1 UNION SELECT e.other FROM ends e SEMI JOIN h1 h ON h.id = e.id),
all_h1 AS MATERIALIZED (SELECT id FROM alive UNION SELECT e.other FROM ends e SEMI JOIN alive a ON a.id = e.id)"""
USAGE = f"""{ALIVE}, uses AS (SELECT subject, object FROM edges WHERE predicate = 'kg:supplies' GROUP BY ALL),
usage AS (SELECT object AS id, count(alive.id) AS n_anchors FROM uses LEFT JOIN alive ON alive.id = subject GROUP BY object HAVING count(alive.id) > 0)"""
STATS = [("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p99.9", 0.999)]


def _distribution(table: str, columns: list[str], stats: list[tuple[str, float]]) -> str:
    rows = [f"SELECT '{name}' AS stat, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p}), 6) AS {c}" for c in columns) + f" FROM {table}" for name, p in stats]
    rows.append("SELECT 'max', " + ", ".join(f"round(max({c})::DOUBLE, 6)" for c in columns) + f" FROM {table}")
    return " UNION ALL ".join(rows)


def _sparsity() -> str:
    lows = {100: "100+", 50: "50-99", 20: "20-49", 10: "10-19", 5: "5-9", 2: "2-4", 1: "1"}
    low = "CASE " + " ".join(f"WHEN deg >= {x} THEN {x}" for x in lows) + " END"
    return f"""WITH {GRAPH}, {DEGREE}, ranges(low, bucket) AS (VALUES {', '.join(f"({x}, '{name}')" for x, name in lows.items())}),
terms AS (SELECT {low} AS low, deg, length(description) AS described, length(synonym) AS called FROM degree JOIN nodes USING (id) WHERE starts_with(id, 'PART:') AND coalesce(deprecated, '') = ''),
sums AS (SELECT low, count(*) AS n, sum(deg)::BIGINT AS ends, avg((coalesce(described, 0) > 0)::INTEGER) AS share, median(coalesce(described, 0)) AS d, median(coalesce(called, 0)) AS c FROM terms GROUP BY low)
SELECT bucket, coalesce(n, 0) AS terms, round(100.0 * coalesce(n, 0) / sum(n) OVER (), 6)::DOUBLE AS pct_terms, coalesce(ends, 0) AS edge_ends, round(100.0 * coalesce(ends, 0) / sum(ends) OVER (), 6)::DOUBLE AS pct_edge_ends,
round(share, 6)::DOUBLE AS has_description, d::DOUBLE AS median_description, c::DOUBLE AS median_synonym FROM ranges LEFT JOIN sums USING (low)"""


CLOSURE = f"""WITH RECURSIVE {GRAPH}, {ENDS}, hops(hop) AS (SELECT range::INTEGER FROM range(0, 13)),
walk AS (SELECT 'NATION:3' AS id, 0 AS hop UNION SELECT e.other, w.hop + 1 FROM walk w JOIN (SELECT DISTINCT id, other FROM ends) e ON e.id = w.id WHERE w.hop < 12),
reached AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id),
last AS (SELECT least(12, max(hop) + 1) AS hop FROM reached),
pairs AS (SELECT greatest(a.hop, b.hop) AS hop, count(*) AS n FROM edges e JOIN reached a ON a.id = e.subject JOIN reached b ON b.id = e.object GROUP BY 1)
SELECT h.hop, (SELECT count(*) FROM reached r WHERE r.hop <= h.hop) AS nodes, (SELECT count(*) FROM reached r WHERE r.hop = h.hop OR (h.hop = 1 AND r.hop = 0)) AS new_nodes,
       (SELECT coalesce(sum(n), 0)::BIGINT FROM pairs p WHERE p.hop <= h.hop) AS induced_edges, round(100.0 * (SELECT count(*) FROM reached r WHERE r.hop <= h.hop) / (SELECT count(*) FROM nodes), 6)::DOUBLE AS pct_nodes
FROM hops h, last WHERE h.hop BETWEEN 1 AND last.hop"""

TRAVERSE = "WITH {graph}, {adjacent}, asked(anchor, predicate) AS (VALUES {rows}) SELECT q.anchor, q.predicate, a.other AS other_id, n.category, n.name, a.dir FROM asked q JOIN adjacent a ON a.node = q.anchor AND a.predicate = q.predicate LEFT JOIN nodes n ON n.id = a.other"


def _traverse(rows: str) -> str:
    return TRAVERSE.format(graph=GRAPH, adjacent=ADJACENT, rows=rows)


TEXT = "concat_ws('. ', name, synonym, description)"
TRIPLES = """triples AS (
  SELECT e.subject, e.predicate, e.object, concat_ws(' ', s.name, replace(replace(e.predicate, 'kg:', ''), '_', ' '), o.name) AS text
  FROM edges e JOIN nodes s ON s.id = e.subject JOIN nodes o ON o.id = e.object WHERE s.name IS NOT NULL AND s.name <> '' AND o.name IS NOT NULL AND o.name <> ''
)"""
G = f"WITH {GRAPH}"
COUNTED_IDS = "('SUPP:1'), ('PART:5'), ('CUST:2'), ('ORD:3'), ('ORD:97'), ('NATION:3'), ('NONE')"


def oracle_sql() -> dict[str, str]:
    return {
        "graph_nodes_count": f"{G} SELECT count(*) AS n FROM nodes",
        "graph_edges_by_predicate": f"{G} SELECT predicate, count(*) AS n FROM edges GROUP BY 1",
        "cut_edges": f"{G}, {CUT} SELECT * FROM kept_edges",
        "cut_nodes": f"{G}, {CUT} SELECT * FROM kept_nodes",
        "cut_audit": f"""{G}, {CUT} SELECT (SELECT count(*) FROM kept_nodes) AS nodes, (SELECT count(*) FROM kept_edges) AS edges,
(SELECT count(*) FROM kept_nodes WHERE in_taxon_label IS NOT NULL AND in_taxon_label <> 'Homo sapiens') AS leaked_taxon, (SELECT count(*) FROM kept_nodes WHERE split_part(id, ':', 1) NOT IN {ALLOWED}) AS leaked_namespace""",
        "relevance_cuts": _relevance_cuts(),
        "predicate_cuts": _predicate_cuts(),
        "degree": f"{G}, {DEGREE} SELECT * FROM degree",
        "hub_top20": f"{G}, {DEGREE}, {SEEDS}, {FRONTIER} SELECT n.id, n.name, n.category, d.deg FROM frontier f JOIN degree d ON d.id = f.id JOIN nodes n ON n.id = f.id ORDER BY d.deg DESC, n.id LIMIT 20",
        "hub_predicates": f"""{G}, {DEGREE}, {SEEDS}, {FRONTIER}, placed AS (SELECT f.id, row_number() OVER (ORDER BY d.deg DESC, f.id) AS place FROM frontier f JOIN degree d USING (id)),
numbered AS (SELECT row_number() OVER () AS no, subject, object, predicate FROM edges), touching AS (SELECT no, predicate FROM numbered JOIN placed ON id = subject WHERE place <= 5 UNION SELECT no, predicate FROM numbered JOIN placed ON id = object WHERE place <= 5)
SELECT predicate, count(*) AS n FROM touching GROUP BY predicate ORDER BY n DESC, predicate LIMIT 8""",
        "cut_hubs": f"{G}, {CUT}, d AS (SELECT id, count(*) AS deg FROM (SELECT subject AS id FROM kept_edges UNION ALL SELECT object FROM kept_edges) GROUP BY 1) SELECT n.id, n.name, n.category, d.deg FROM d JOIN kept_nodes n ON n.id = d.id ORDER BY deg DESC, n.id LIMIT 20",
        "seeds_by_pattern": f"{G}, {ALIVE}, pats(pattern) AS (VALUES ('#00000000'), ('7'), ('no such name')) SELECT pattern, id FROM alive JOIN pats ON lower(name) LIKE '%' || pattern || '%'",
        "expand_one_hop": f"{G}, {SEEDS}, {H1} SELECT id FROM h1",
        "incident_edges": f"{G}, {SEEDS} SELECT * FROM edges WHERE {INCIDENT.format('seeds')}",
        "induced_edges": f"{G}, {SEEDS}, {H1}, every AS MATERIALIZED (FROM edges), inner_ids AS MATERIALIZED (SELECT id FROM h1 GROUP BY id) SELECT every.* FROM every JOIN inner_ids s ON s.id = subject JOIN inner_ids o ON o.id = object",
        "traverse_out": _traverse("('SUPP:1', 'kg:supplies')"),
        "traverse_in": _traverse("('CUST:1', 'kg:placed_by'), ('PART:9', 'kg:contains')"),
        "traverse_both": _traverse("('NATION:3', 'kg:located_in'), ('NATION:3', 'kg:part_of'), ('REGION:1', 'kg:part_of')"),
        "edge_count_of": f"{G}, ids(id) AS (VALUES {COUNTED_IDS}) SELECT i.id, count(e.subject) AS n_edges FROM ids i LEFT JOIN edges e ON (e.subject = i.id OR e.object = i.id) AND e.predicate IN ('kg:supplies', 'kg:contains', 'kg:placed_by') GROUP BY 1",
        "dangling_edges": f"{G} SELECT e.* FROM edges e LEFT JOIN nodes s ON s.id = e.subject LEFT JOIN nodes o ON o.id = e.object WHERE s.id IS NULL OR o.id IS NULL",
        "composition_category": _breakdown("nodes", "replace(category, 'kg:', '')"), "composition_species": _breakdown("nodes", "in_taxon_label"),
        "composition_predicate": _breakdown("edges", "replace(predicate, 'kg:', '')"), "composition_knowledge_level": _breakdown("edges", "knowledge_level"),
        "composition_agent_type": _breakdown("edges", "agent_type"), "composition_source": _breakdown("edges", "primary_knowledge_source"),
        "composition_endpoint_species": f"""{G}, tagged AS (SELECT CASE WHEN s.in_taxon_label IS NULL AND o.in_taxon_label IS NULL THEN 'both taxon-free'
WHEN coalesce(s.in_taxon_label, 'Homo sapiens') = 'Homo sapiens' AND coalesce(o.in_taxon_label, 'Homo sapiens') = 'Homo sapiens' THEN 'human (or taxon-free)' ELSE 'touches a non-human species' END AS bucket
FROM edges e JOIN nodes s ON s.id = e.subject JOIN nodes o ON o.id = e.object) SELECT bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM edges), 6)::DOUBLE AS pct FROM tagged GROUP BY 1""",
        "neighbour_distribution": f"{G}, {SHAPE} {_distribution('around', ['h1_nodes', 'h2_edges_ub'], STATS)}",
        "neighbourhoods": f"{G}, {SHAPE} SELECT * FROM around",
        "threshold_shares": f"{G}, {SHAPE}, t(threshold) AS (VALUES (1000::BIGINT), (10000), (20000), (100000)) SELECT threshold, count(*) FILTER (WHERE h2_edges_ub > threshold) AS n, round(100.0 * count(*) FILTER (WHERE h2_edges_ub > threshold) / count(*), 6)::DOUBLE AS pct FROM t, around GROUP BY threshold",
        "exact_h2_sample": f"""{G}, {SHAPE}, numbered AS (SELECT row_number() OVER () AS edge, subject, object FROM edges), sample AS (SELECT id FROM around ORDER BY md5(id || '42'), id LIMIT 12),
near AS (SELECT s.id, count(*) AS h1_edges FROM sample s JOIN numbered e ON e.subject = s.id OR e.object = s.id GROUP BY 1),
far AS (SELECT n.id, count(DISTINCT edge) AS h2_edges FROM links n JOIN sample USING (id) JOIN (SELECT edge, subject AS node FROM numbered UNION SELECT edge, object FROM numbered) e ON e.node = n.other GROUP BY 1)
SELECT id, h1_edges, h2_edges, h2_edges_ub, round(h2_edges_ub / greatest(h2_edges, 1), 6)::DOUBLE AS ratio FROM sample JOIN near USING (id) JOIN far USING (id) JOIN around USING (id)""",
        "sparsity_buckets": _sparsity(),
        "pattern_shape": _pattern_shapes(),
        "subset_sizes": f"{G}, {SUBSETS} " + " UNION ALL ".join(f"SELECT '{name}' AS subset, (SELECT count(*) FROM {t}) AS nodes, (SELECT count(*) FROM edges WHERE {INDUCED.format(t)}) AS induced" for name, t in (("union_h1", "h1"), ("union_h2", "h2"), ("all_h1", "all_h1"))),
        "subset_categories": f"{G}, {SUBSETS}, kinds AS (SELECT count(*) AS n, coalesce(nullif(split_part(category, 'kg:', 2), ''), category, '?') AS category FROM nodes WHERE id IN (FROM all_h1) GROUP BY ALL) SELECT category, n FROM kinds QUALIFY row_number() OVER (ORDER BY n DESC, category) <= 8",
        "subset_predicates": f"""{G}, {SUBSETS}, inner_edges AS (SELECT predicate FROM edges JOIN all_h1 s ON s.id = subject JOIN all_h1 o ON o.id = object),
words AS (SELECT split_part(predicate, 'kg:', 2) AS predicate, count(*) AS n FROM inner_edges GROUP BY ALL) SELECT predicate, n FROM words QUALIFY row_number() OVER (ORDER BY n DESC, predicate) <= 10""",
        "object_usage": f"{G}, {USAGE} SELECT u.id, n.name, u.n_anchors, round(100.0 * u.n_anchors / (SELECT count(*) FROM alive), 6)::DOUBLE AS pct FROM usage u JOIN nodes n ON n.id = u.id ORDER BY u.n_anchors DESC, u.id LIMIT 15",
        "object_usage_percentiles": f"{G}, {USAGE} {_distribution('usage', ['n_anchors'], [STATS[0], STATS[1], STATS[2], STATS[4]])}",
        "closure_by_hop": CLOSURE,
        "node_text": f"{G} SELECT id, category, {TEXT} AS text FROM nodes WHERE {TEXT} <> ''",
        "triple_text": f"{G}, {TRIPLES} SELECT * FROM triples",
        "text_stats": f"""{G}, {TRIPLES} SELECT count(*) FILTER (WHERE {TEXT} <> '') AS node_docs, count(*) FILTER (WHERE {TEXT} = '') AS nodes_dropped, count(*) FILTER (WHERE description IS NOT NULL AND description <> '') AS with_description,
round(avg(length({TEXT})), 6) AS avg_chars, (SELECT count(*) FROM triples) AS triple_docs, (SELECT count(*) FROM edges) - (SELECT count(*) FROM triples) AS triples_dropped FROM nodes""",
        "synonyms_parsed": f"""{G} SELECT id, CASE WHEN id LIKE 'PART:%' THEN regexp_replace(synonym, '^\\[([^,]*), ''(.*)''\\]$', '\\1|\\2') ELSE replace(substr(synonym, 2, length(synonym) - 2), ', ', '|') END AS parsed,
CASE WHEN id LIKE 'CUST:%' THEN 1 ELSE 2 END::BIGINT AS n FROM nodes WHERE synonym IS NOT NULL""",
        "cosine_topk": f"WITH {VECTORS} SELECT id, round(list_cosine_similarity(embedding, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS sim FROM gallery ORDER BY sim DESC, id LIMIT 10",
        "batched_topk": f"""WITH {VECTORS}, sims AS (SELECT q.vec_id AS question_id, g.id, round(list_cosine_similarity(q.embedding::DOUBLE[], g.embedding), 6) AS sim FROM embeddings q CROSS JOIN gallery g)
SELECT question_id, id, sim, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, id)::INTEGER AS rank FROM sims QUALIFY rank <= 20""",
        "rank_of_target": f"WITH {RANKS} SELECT * FROM ranks",
        "synonym_mrr": f"WITH {RANKS} SELECT {QUALITY} FROM ranks",
        "recall_at_k": f"WITH {RANKS} SELECT split_part(target, ':', 1) || (question_id % 3) AS ns, {QUALITY} FROM ranks GROUP BY 1 HAVING count(*) >= 20",
        "predicate_margin": f"WITH {SCORES}, {SCORED} SELECT question_id, predicate, score, predicate_rank FROM chosen",
        "predicate_calibration": f"""WITH {SCORES}, {SCORED}, truth(type, predicate) AS (VALUES ('even', 'kg:supplies'), ('even', 'kg:placed_by'), ('odd', 'kg:contains')),
typed AS (SELECT question_id, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS type, predicate, score FROM scores),
best AS (SELECT question_id, type, max(score) FILTER (WHERE (type, predicate) IN (SELECT (type, predicate) FROM truth)) AS t, max(score) FILTER (WHERE (type, predicate) NOT IN (SELECT (type, predicate) FROM truth)) AS d FROM typed GROUP BY 1, 2)
SELECT type, round(avg(t), 6) AS true_score, round(avg(d), 6) AS distractor_score, round(avg(t) - avg(d), 6) AS gap FROM best GROUP BY 1""",
        "disambiguate_batch": f"{G}, {VECTORS}, {SCORES}, {CRAWL} SELECT question_id, anchor, rank, n_edges FROM found",
        "crawl_facts": f"{G}, {VECTORS}, {SCORES}, {CRAWL} SELECT * FROM facts",
        "crawl_neighbours": f"{G}, {VECTORS}, {SCORES}, {CRAWL} SELECT DISTINCT question_id, anchor, other_id FROM facts",
        "gold_cases": f"{G}, {GOLD} SELECT DISTINCT id, type, question, anchor, n_answers FROM gold",
        "gold_answers": f"{G}, {GOLD} SELECT id, answer FROM gold",
        "gold_summary": f"""{G}, {GOLD}, sizes AS (SELECT DISTINCT id, type, n_answers FROM gold), sorted AS (SELECT type, n_answers, row_number() OVER (PARTITION BY type ORDER BY n_answers) - 1 AS i, count(*) OVER (PARTITION BY type) AS n FROM sizes)
SELECT type, max(n) AS cases, max(n_answers) FILTER (WHERE i = n // 2) AS median_answers, max(n_answers) AS max_answers FROM sorted GROUP BY 1""",
        "score_node": f"""{G}, {VECTORS}, {HALF_GOLD}, {GOLD_ASKED}, hits AS (
  SELECT question_id AS id, hit FROM (SELECT question_id, g.id AS hit, round(list_cosine_similarity(a.embedding, g.embedding), 6) AS sim FROM asked a CROSS JOIN gallery g) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, hit) <= 20
){SCORE}""",
        "score_triple": f"""{G}, {VECTORS}, {HALF_GOLD}, {GOLD_ASKED}, tv AS (
  SELECT subject, object, subject || '|' || predicate || '|' || object AS key, list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1] + p[2]) / 2) AS embedding
  FROM (SELECT DISTINCT subject, predicate, object FROM edges) JOIN gallery a ON a.id = subject JOIN gallery b ON b.id = object
), near AS (
  SELECT question_id, subject, object FROM (SELECT question_id, t.subject, t.object, t.key, round(list_cosine_similarity(a.embedding, t.embedding), 6) AS sim FROM asked a CROSS JOIN tv t) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, key) <= 20
), hits AS (SELECT DISTINCT question_id AS id, unnest([subject, object]) AS hit FROM near){SCORE}""",
        "score_crawl": f"""{G}, {VECTORS}, {HALF_GOLD}, {SCORES.split(', asked AS')[0]}, {GOLD_ASKED}, {CRAWL.replace('label, ', '', 1)}, reached AS (SELECT DISTINCT question_id AS id, other_id AS hit FROM facts), right_ones AS (SELECT DISTINCT question_id AS id, anchor FROM facts),
scored AS (SELECT g.id, g.type, count(h.hit)::DOUBLE / count(*) AS recall, max(CASE WHEN r.anchor = g.anchor THEN 1.0 ELSE 0.0 END) AS anchor_hit
FROM gold g LEFT JOIN reached h ON h.id = g.id AND h.hit = g.answer LEFT JOIN right_ones r ON r.id = g.id GROUP BY g.id, g.type), types(type) AS (VALUES ('supplied'), ('seat'), ('overall'))
SELECT t.type, count(s.id) AS n, coalesce(round(avg(s.recall), 6), 0.0) AS recall, coalesce(round(avg(s.anchor_hit), 6), 0.0)::DOUBLE AS anchor_hit FROM types t LEFT JOIN scored s ON t.type = s.type OR t.type = 'overall' GROUP BY t.type""",
        "synonym_queries": f"{G}, {SYNONYMS} SELECT * FROM queries",
        "synonym_gallery": f"{G}, {SYNONYMS}, g AS (SELECT id, name FROM nodes WHERE name IS NOT NULL AND name <> '' ORDER BY md5(id || '7'), id LIMIT 1000) SELECT * FROM g UNION SELECT id, name FROM nodes WHERE id IN (SELECT target FROM queries)",
        "unique_ids": f"{G} SELECT count(*) AS rows, count(DISTINCT id) AS distinct_ids FROM nodes",
        "dangling_count": f"{G} SELECT count(*) AS dangling FROM edges e LEFT JOIN nodes s ON s.id = e.subject LEFT JOIN nodes o ON o.id = e.object WHERE s.id IS NULL OR o.id IS NULL",
        "empty_docs": f"{G} SELECT count(*) AS empty_docs FROM nodes WHERE {TEXT} <> '' AND trim({TEXT}) = ''",
        "row_parity": f"{G}, {TRIPLES}, named AS (SELECT id FROM nodes WHERE name IS NOT NULL AND name <> '') SELECT (SELECT count(*) FROM triples) AS triples, (SELECT count(*) FROM edges WHERE {INDUCED.format('named')}) AS named_edges",
        "leak_trivial": f"{G}, {SYNONYMS} SELECT count(*) AS leaks FROM queries q JOIN nodes n ON n.id = q.target WHERE lower(trim(q.query)) = lower(trim(n.name))",
        "leak_ambiguous": f"""{G}, {SYNONYMS}, hits AS (SELECT DISTINCT q.query, q.target FROM queries q JOIN nodes n ON lower(trim(n.name)) = lower(trim(q.query)) AND n.id <> q.target)
SELECT (SELECT count(*) FROM queries) AS queries, (SELECT count(*) FROM hits) AS ambiguous, round((SELECT count(*) FROM hits) / (SELECT count(*) FROM queries), 6)::DOUBLE AS rate""",
        "hash_sample": f"{G} SELECT id, category FROM nodes ORDER BY md5(id || '7'), id LIMIT 1000",
    }
