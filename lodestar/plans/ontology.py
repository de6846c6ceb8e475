"""Queries on vocabularies: parsing and building an ontology, resolving terms in steps, value maps; and staged records of archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import predicates as P
from lodestar.operators import ranking
from lodestar.operators.textindex import USER_WORD
from lodestar.plans.binding import Catalog
from lodestar.plans.queries import count, query
from lodestar.sources.shared import kept, small_side

col, lit = F.col, F.lit

#: Terms: regions over nations over customers, with synonyms; customers are leaves with few values, nations have many.
_TERMS = """terms AS (SELECT 'R:' || r_regionkey AS id, lower(r_name) AS label, [lower(r_name) || ' area', 'zone ' || r_regionkey] AS synonyms, NULL AS parent FROM region
 UNION ALL SELECT 'N:' || n_nationkey, lower(n_name), ['country ' || n_nationkey], 'R:' || n_regionkey FROM nation UNION ALL
  SELECT 'C:' || c_custkey, lower(c_name), []::VARCHAR[], 'N:' || c_nationkey FROM customer)"""


def terms(k: Catalog) -> DataFrame:
    r, n, c = k.table("region"), k.table("nation"), k.table("customer")
    made = lambda df, kind, key, name, synonyms, parent: df.select(F.concat(lit(f"{kind}:"), col(key).cast("string")).alias("id"), F.lower(name).alias("label"), synonyms.alias("synonyms"), parent.alias("parent"))
    none = F.array().cast("array<string>")
    return (
        made(r, "R", "r_regionkey", "r_name", F.array(F.concat(F.lower("r_name"), lit(" area")), F.concat(lit("zone "), col("r_regionkey").cast("string"))), lit(None).cast("string"))
        .union(made(n, "N", "n_nationkey", "n_name", F.array(F.concat(lit("country "), col("n_nationkey").cast("string"))), F.concat(lit("R:"), col("n_regionkey").cast("string"))))
        .union(made(c, "C", "c_custkey", "c_name", none, F.concat(lit("N:"), col("c_nationkey").cast("string"))))
    )


@query("""SELECT n_nationkey, 'N:' || n_nationkey AS id, n_name AS name, 'R:' || n_regionkey AS parents, 'country ' || n_nationkey || '|land' AS synonyms, 'a \"land\" of ' || n_name AS definition FROM nation WHERE n_nationkey % 5 <> 4""")
def parse_obo(k: Catalog) -> DataFrame:
    """Term stanzas made of the nations; obsolete ones (every fifth) go. Quotation marks inside a definition are kept."""
    key = col("n_nationkey").cast("string")
    lines = [lit("[Term]"), F.concat(lit("id: N:"), key), F.concat(lit("name: "), "n_name"), F.concat(lit('def: "a \\"land\\" of '), "n_name", lit('" [X:1]'))]
    lines += [F.concat(lit('synonym: "country '), key, lit('" EXACT []')), lit('synonym: "land" BROAD []'), F.concat(lit("is_a: R:"), col("n_regionkey").cast("string"), lit(" ! region"))]
    lines += [F.when(col("n_nationkey") % 5 == 4, "is_obsolete: true")]
    s = k.table("nation").select("n_nationkey", F.array_join(F.array_compact(F.array(*lines)), "\n").alias("s"))
    return s.filter(col("s").startswith("[Term]") & ~col("s").contains("is_obsolete: true")).select("n_nationkey", *obo_fields(col("s")))


def obo_fields(s: Column) -> list[Column]:
    """id, name, parents, synonyms and definition of a stanza."""
    one = lambda p: F.nullif(F.regexp_extract(s, p, 1), lit(""))
    every = lambda p: F.regexp_extract_all(s, lit(p), 1)
    return [
        one(r"(?m)^id: (\S+)").alias("id"), one(r"(?m)^name: (.+)$").alias("name"), F.array_join(every(r"(?m)^is_a: (\S+)"), ",").alias("parents"),
        F.array_join(every(r'(?m)^synonym: "((?:[^"\\]|\\.)*)"'), "|").alias("synonyms"), F.replace(one(r'(?m)^def: "((?:[^"\\]|\\.)*)"'), lit('\\"'), lit('"')).alias("definition"),
    ]


@query(f"WITH {_TERMS}, two AS (SELECT id, label, 0 AS age FROM terms UNION ALL SELECT id, label || ' (new)', 1 FROM terms WHERE parent LIKE 'R:%') SELECT id, arg_max(label, age) AS label FROM two GROUP BY 1")
def onto_build(k: Catalog) -> DataFrame:
    """Insert or replace: of the terms of one id the newest stays. Written as a table and read again."""
    new = terms(k).filter("parent like 'R:%'").select("id", F.concat("label", lit(" (new)")).alias("label"), lit(1).alias("age"))
    both = terms(k).select("id", "label", lit(0).alias("age")).union(new)
    return kept(both.groupBy("id").agg(F.max_by("label", "age").alias("label")), "ontology")


_VALUES = """db AS (SELECT CASE c_custkey % 4 WHEN 0 THEN upper(r_name) WHEN 1 THEN ' ' || lower(r_name) || ' area' WHEN 2 THEN 'Country ' || n_nationkey
  ELSE 'EFO_000' || c_custkey END AS value, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""


def db_values(k: Catalog) -> DataFrame:
    c = k.table("customer").join(k.table("nation"), col("c_nationkey") == col("n_nationkey")).join(k.table("region"), col("n_regionkey") == col("r_regionkey"))
    i = col("c_custkey") % 4
    value = F.when(i == 0, F.upper("r_name")).when(i == 1, F.concat(lit(" "), F.lower("r_name"), lit(" area"))).when(i == 2, F.concat(lit("Country "), col("n_nationkey").cast("string"))).otherwise(F.concat(lit("EFO_000"), col("c_custkey").cast("string")))
    return k.table("orders").join(c.select(col("c_custkey").alias("o_custkey"), value.alias("value")), "o_custkey").select("value")


_MAP = f"""{_TERMS}, {_VALUES}, names AS (SELECT id, label AS name FROM terms UNION SELECT id, unnest(synonyms) FROM terms), counted AS (SELECT value, count(*) AS n
  FROM db WHERE NOT regexp_matches(value, '^[A-Z]+_[0-9]+$') GROUP BY 1),
 map AS (SELECT id, value, n FROM names JOIN counted ON lower(trim(value)) = name)"""


@query(f"WITH {_MAP} SELECT id, value, n FROM map")
def onto_value_map(k: Catalog) -> DataFrame:
    """Which values of the data stand for which term: by label or synonym, whatever the case; bare ids stand for none."""
    return value_map(k)


def value_map(k: Catalog) -> DataFrame:
    names = terms(k).select("id", F.explode(F.array_distinct(F.concat(F.array("label"), "synonyms"))).alias("name"))
    counted = db_values(k).filter(~col("value").rlike("^[A-Z]+_[0-9]+$")).groupBy("value").agg(count())
    return counted.join(names, F.lower(F.trim("value")) == col("name")).select("id", "value", "n")


@query(f"""WITH {_MAP}, kids AS (SELECT p.id AS term, count(*) AS k FROM terms p JOIN terms c ON c.parent = p.id
  GROUP BY 1), below AS (SELECT parent AS term, id AS below, 1 AS depth FROM terms WHERE parent IS NOT NULL UNION ALL SELECT g.parent, t.id, 2 FROM terms t
  JOIN terms g ON t.parent = g.id WHERE g.parent IS NOT NULL),
 v AS (SELECT term, depth, value, n FROM below JOIN map ON map.id = below.below), c AS (SELECT term, count(DISTINCT value) FILTER (depth = 1) AS direct FROM v GROUP BY 1)
 SELECT term, value, n FROM v JOIN c USING (term) WHERE depth = 1 OR direct < 5 GROUP BY ALL""")
def onto_expand_values(k: Catalog) -> DataFrame:
    """Values of a term's children, and of all below it where those are fewer than five."""
    t, m = terms(k), value_map(k)
    one = t.filter("parent is not null").select(col("parent").alias("term"), col("id").alias("below"))
    two = one.join(t.select(col("id").alias("term"), "parent"), "term").filter("parent is not null").select(col("parent").alias("term"), "below")
    v = one.withColumn("depth", lit(1)).union(two.withColumn("depth", lit(2))).join(m, col("below") == col("id")).select("term", "depth", "value", "n")
    direct = v.groupBy("term").agg(F.countDistinct(F.when(col("depth") == 1, col("value"))).alias("direct"))
    return v.join(direct, "term").filter("depth = 1 or direct < 5").select("term", "value", "n").distinct()


_ASKED = """asked AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Old World' WHEN 1 THEN 'asia' WHEN 2 THEN 'Zone ' || (doc_id % 7)
  WHEN 3 THEN 'nation_' || (doc_id % 30) || ' x' WHEN 4 THEN 'country ' || (doc_id % 30) ELSE 'nothing known ' || lang END AS term FROM documents)"""


def asked(k: Catalog) -> DataFrame:
    s = lambda c: c.cast("string")
    i = col("doc_id")
    kinds = [lit("Old World"), lit("asia"), F.concat(lit("Zone "), s(i % 7)), F.concat(lit("nation_"), s(i % 30), lit(" x")), F.concat(lit("country "), s(i % 30)), F.concat(lit("nothing known "), "lang")]
    return k.table("documents").select("doc_id", F.get(F.array(*kinds), (i % 6).cast("int")).alias("term"))


@query(f"""WITH {_TERMS}, {_ASKED}, few AS (SELECT * FROM terms WHERE id NOT LIKE 'C:%'), u AS (SELECT 'old world' AS name, unnest(['R:0', 'R:2', 'R:3']) AS id),
 f AS (SELECT doc_id, term, 0 AS step, u.id FROM asked JOIN u ON lower(term) = name UNION ALL SELECT doc_id, term, 1, id FROM asked JOIN few ON lower(term) = label
 UNION ALL SELECT doc_id, term, 2, id FROM asked JOIN (SELECT id, unnest(synonyms) AS s FROM few) ON lower(term) = s UNION ALL SELECT doc_id, term, 3, id FROM asked
  JOIN few ON lower(split_part(term, ' ', 1)) = label)
 SELECT doc_id, term, ['umbrella', 'exact', 'synonym', 'fuzzy'][s + 1] AS step, ids FROM (SELECT doc_id, term, min(step) AS s, string_agg(id, ','
  ORDER BY id) FILTER (step = least_step) AS ids FROM (SELECT *, min(step) OVER (PARTITION BY doc_id) AS least_step FROM f) GROUP BY 1, 2)
 UNION ALL SELECT doc_id, term, 'none', NULL FROM asked WHERE doc_id NOT IN (SELECT doc_id FROM f)""")
def onto_resolve_ranked(k: Catalog) -> DataFrame:
    """Terms resolved in steps: umbrella words, exact labels, synonyms, labels of a part of the words; the first step that
    finds something counts."""
    few = small_side(kept(terms(k).filter("id not like 'C:%'"), "terms"))
    a = asked(k).withColumn("low", F.lower("term"))
    umbrella = k.spark.createDataFrame([("old world", i) for i in ("R:0", "R:2", "R:3")], "low string, id string")
    word = F.explode(F.filter(F.split("low", " "), lambda w: F.length(w) > 2))
    steps = [F.broadcast(umbrella), few.select(col("label").alias("low"), "id"), few.select(F.explode("synonyms").alias("low"), "id")]
    found = [a.join(t, "low").select("doc_id", "term", lit(i).alias("step"), "id") for i, t in enumerate(steps)]
    found.append(a.select("doc_id", "term", word.alias("low")).join(steps[1], "low").select("doc_id", "term", lit(3).alias("step"), "id"))
    f = reduce(DataFrame.union, found).groupBy("doc_id", "term", "step").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias("ids")).groupBy("doc_id", "term").agg(F.min(F.struct("step", "ids")).alias("b"))
    names = F.array(*map(lit, ("umbrella", "exact", "synonym", "fuzzy")))
    x = a.join(f.select("doc_id", "b"), "doc_id", "left")
    return x.select("doc_id", "term", F.coalesce(F.get(names, col("b.step")), lit("none")).alias("step"), col("b.ids").alias("ids"))


@query("""WITH l AS (SELECT user_id % 40 AS term, event_type AS canonical, value AS confidence, event_id
  FROM events), b AS (SELECT term, canonical, arg_max(confidence, event_id) AS confidence FROM l GROUP BY 1, 2)
  SELECT term, arg_max(canonical, (confidence, canonical)) AS canonical, max(confidence) AS confidence FROM b GROUP BY 1""")
def learned_synonyms(k: Catalog) -> DataFrame:
    """Synonyms learned from use: the last confidence of a pair counts, and of a term's pairs the surest one."""
    log = k.table("events").select((col("user_id") % 40).alias("term"), col("event_type").alias("canonical"), "value", "event_id")
    pairs = log.groupBy("term", "canonical").agg(F.max_by("value", "event_id").alias("confidence"))
    return pairs.groupBy("term").agg(F.max(F.struct("confidence", "canonical")).alias("b")).select("term", "b.canonical", "b.confidence")


@query("""WITH a AS (SELECT doc_id, [lang, source] AS ts FROM documents), g AS (SELECT source AS t, lang AS g FROM documents
  GROUP BY ALL), x AS (SELECT DISTINCT a.t, b.t AS other FROM g a JOIN g b USING (g))
 SELECT doc_id, list_aggregate(list_sort(list_distinct(flatten([[t], coalesce(o, [])]))), 'string_agg', ',') AS terms FROM (SELECT doc_id, source AS t FROM documents)
  LEFT JOIN (SELECT t, list(other) AS o FROM x GROUP BY 1) USING (t)""")
def synonym_expand(k: Catalog) -> DataFrame:
    """Terms with all terms of their groups."""
    d = k.table("documents")
    g = d.select(col("source").alias("t"), col("lang").alias("g")).distinct()
    sets = g.join(g.select("g", col("t").alias("other")), "g").groupBy("t").agg(F.collect_set("other").alias("o"))
    x = d.select("doc_id", col("source").alias("t")).join(F.broadcast(sets), "t", "left")
    return x.select("doc_id", F.array_join(F.array_sort(F.array_union(F.array("t"), F.coalesce("o", F.array().cast("array<string>")))), ",").alias("terms"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END AS v FROM documents) SELECT doc_id, v FROM d WHERE v IS NULL OR v NOT IN ('en')""")
def filter_null_category(k: Catalog) -> DataFrame:
    i = col("doc_id") % 4
    return k.table("documents").select("doc_id", F.when(i == 1, "").when(i != 0, col("lang")).alias("v")).filter(P.not_in("v", ["en"], keep_null=True))


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_.-]+'), lambda t: chr(34) || t || chr(34)), ' ') AS q FROM documents""")
def fts_sanitised(k: Catalog) -> DataFrame:
    """Whole texts as safe queries: their words, each quoted, all of them wanted."""
    return k.table("documents").select("doc_id", F.array_join(F.transform(F.regexp_extract_all("text", lit(USER_WORD), 0), lambda t: F.concat(lit('"'), t, lit('"'))), " ").alias("q"))


# Records of archives, staged as nested rows


_STAGED = """staged AS (SELECT p_partkey AS id, p_name AS title, [p_type, lower(split_part(p_name, ' ', 1))] AS tissues, CASE WHEN p_size % 4 = 0 THEN []::VARCHAR[]
  ELSE [p_brand] END AS diseases, CASE p_size % 3 WHEN 0 THEN ['Homo sapiens'] WHEN 1 THEN ['Mus musculus', 'Homo sapiens'] ELSE ['Mus musculus'] END AS organisms, p_size AS n FROM part)"""


def staged(k: Catalog) -> DataFrame:
    """Collections as archives give them: arrays of labelled structs inside."""
    label = lambda *cs: F.transform(F.array(*cs), lambda c: F.struct(c.alias("label")))
    none = F.array().cast("array<struct<label: string>>")
    i = col("p_size")
    organisms = F.when(i % 3 == 0, label(lit("Homo sapiens"))).when(i % 3 == 1, label(lit("Mus musculus"), lit("Homo sapiens"))).otherwise(label(lit("Mus musculus")))
    return k.table("part").select(col("p_partkey").alias("id"), col("p_name").alias("title"), label("p_type", F.lower(F.split_part("p_name", lit(" "), lit(1)))).alias("tissues"), F.when(i % 4 == 0, none).otherwise(label("p_brand")).alias("diseases"), organisms.alias("organisms"), i.alias("n"))


def label_gate(labels: str, words: list[str], free: str) -> Column:
    """Whether a label has one of the words in it or is part of one; without labels the free text is searched."""
    either = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x["label"]), lit(w.lower())) | F.contains(lit(w.lower()), F.lower(x["label"])) for w in words])
    return F.when(F.size(labels) > 0, F.exists(labels, either)).otherwise(ranking.hits(F.lower(free), [w.lower() for w in words]) > 0)


@query(f"""WITH {_STAGED}, g AS (SELECT *, list_bool_or(list_transform(tissues, lambda x: contains(lower(x), 'small') OR contains('small', lower(x)))) AS t, CASE
  WHEN len(diseases) > 0 THEN list_bool_or(list_transform(diseases, lambda x: contains(lower(x), 'brand#1') OR contains('brand#1', lower(x)) OR contains(lower(x), 'gear')
  OR contains('gear', lower(x)))) ELSE contains(lower(title), 'brand#1') OR contains(lower(title), 'gear') END AS d FROM staged)
 SELECT id, title, organisms[1] AS organism, len(tissues) AS n_tissues FROM g WHERE t AND d""")
def nested_gates(k: Catalog) -> DataFrame:
    """Hard gates on nested labels: the tissue and the disease must both be met."""
    x = staged(k).filter(label_gate("tissues", ["small"], "title") & label_gate("diseases", ["Brand#1", "gear"], "title"))
    return x.select("id", "title", col("organisms")[0]["label"].alias("organism"), F.size("tissues").alias("n_tissues"))


@query(f"""WITH {_STAGED} SELECT id, (contains(lower(title), 'bolt'))::INT + (contains(lower(title), 'red'))::INT AS hits FROM staged
  WHERE (contains(lower(title), 'bolt') OR contains(lower(title), 'red')) AND list_contains(organisms, 'Mus musculus')""")
def keyword_species_gate(k: Catalog) -> DataFrame:
    """Experiments with any keyword, of the species asked for."""
    x = staged(k).select("id", ranking.hits(F.lower("title"), ["bolt", "red"]).alias("hits"), "organisms")
    return x.filter((col("hits") > 0) & F.exists("organisms", lambda o: o["label"] == "Mus musculus")).select("id", "hits")


@query(f"WITH {_STAGED}, f AS (SELECT id FROM staged WHERE contains(lower(title), 'no such part') LIMIT 150), w AS (SELECT id FROM staged ORDER BY id LIMIT 150) SELECT id FROM f UNION ALL SELECT id FROM w WHERE NOT EXISTS (SELECT 1 FROM f)")
def filter_else_sweep(k: Catalog) -> DataFrame:
    """The filtered records, or, if there are none, two pages of all."""
    x = staged(k).select("id", "title")
    found = x.filter(F.contains(F.lower("title"), lit("no such part"))).limit(150)
    return (x.orderBy("id").limit(150) if found.isEmpty() else found).select("id")


@query("""SELECT p_partkey AS id, 'SRX' || (1000000 + p_partkey) AS accession, CASE p_size % 3 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'Mus musculus' END AS organism
  FROM part WHERE p_type IN ('PROMO', 'SMALL')""")
def archive_fragments(k: Catalog) -> DataFrame:
    """Fields taken out of XML fragments, of experiments of the strategies asked for."""
    organism = F.when(col("p_size") % 3 == 0, "Homo sapiens").when(col("p_size") % 3 == 1, "Mus musculus")
    xml = F.concat(lit('<Summary><Experiment acc="SRX'), (1000000 + col("p_partkey")).cast("string"), lit('" strategy="'), "p_type", lit('"/>'), F.coalesce(F.concat(lit('<Organism taxid="1" ScientificName="'), organism, lit('"/>')), lit("")), lit("</Summary>"))
    x = k.table("part").select(col("p_partkey").alias("id"), xml.alias("x"))
    at = lambda path: F.nullif(F.xpath_string("x", lit(path)), lit(""))
    return x.filter(at("Summary/Experiment/@strategy").isin("PROMO", "SMALL")).select("id", at("Summary/Experiment/@acc").alias("accession"), at("Summary/Organism/@ScientificName").alias("organism"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 2 ELSE NULL END AS lo, doc_id % 30 AS hi, CASE doc_id % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'month'
  WHEN 2 THEN 'week' ELSE 'day' END AS unit FROM documents)
 SELECT doc_id, round(lo / CASE unit WHEN 'year' THEN 1 WHEN 'month' THEN 12 WHEN 'week' THEN 52 ELSE 365 END, 6) AS lo_years, round(hi / CASE unit WHEN 'year' THEN 1
  WHEN 'month' THEN 12 WHEN 'week' THEN 52 ELSE 365 END, 6) AS hi_years FROM d""")
def age_in_years(k: Catalog) -> DataFrame:
    i = col("doc_id")
    d = k.table("documents").select("doc_id", F.when(i % 3 == 0, 2).alias("lo"), (i % 30).alias("hi"), F.get(F.array(*map(lit, ("year", "month", "week", "day"))), (i % 4).cast("int")).alias("unit"))
    per = F.create_map(*[lit(x) for pair in (("year", 1), ("month", 12), ("week", 52), ("day", 365)) for x in pair])[col("unit")]
    return d.select("doc_id", F.round(col("lo") / per, 6).alias("lo_years"), F.round(col("hi") / per, 6).alias("hi_years"))


@query("""SELECT source AS field, list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS wanted, min(confidence) AS confidence
  FROM (SELECT source, lang, (1 + doc_id % 10) / 10 AS confidence FROM documents) GROUP BY 1""")
def merged_conditions(k: Catalog) -> DataFrame:
    """Conditions on one field are one: all their values, the least confidence."""
    d = k.table("documents").select(col("source").alias("field"), "lang", ((1 + col("doc_id") % 10) / 10).alias("c"))
    return d.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("wanted"), F.min("c").alias("confidence"))


_INVENTORY = {"orders": "samples", "part": "series", "customer": "projects", "lineitem": "celltypes"}


@query(" UNION ALL ".join(f"SELECT '{tier}' AS tier, (SELECT count(*) FROM {t}) AS n, count(*) AS columns, string_agg(column_name, ',' ORDER BY column_name) AS names FROM (DESCRIBE {t})" for t, tier in _INVENTORY.items()))
def schema_summary(k: Catalog) -> DataFrame:
    """Each tier's table: rows, and its columns from the schema."""
    parts = []
    for t, tier in _INVENTORY.items():
        names = sorted(k.table(t).columns)
        parts.append(k.table(t).agg(lit(tier).alias("tier"), count(), lit(len(names)).cast("long").alias("columns"), lit(",".join(names)).alias("names")))
    return reduce(DataFrame.union, parts)
