"""Stand-ins for the confidential receipt tables, derived from the driver's tables.

Each text is valid both in Spark SQL and in the check database. A view may use
the ones before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "part", "documents")
FACTS = ("orders", "documents")

VIEWS: dict[str, str] = {
    "receipts": """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 10
    WHEN 0 THEN '0000000' || CAST(20000000 + p_partkey AS VARCHAR(8))
    WHEN 1 THEN '550000' || CAST(20000000 + p_partkey AS VARCHAR(8))
    WHEN 2 THEN '003' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0')
    WHEN 3 THEN ' 3' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0') || ' '
    WHEN 4 THEN lpad(CAST(p_partkey AS VARCHAR(5)), 5, '0')
    WHEN 5 THEN '978' || lpad(CAST(p_partkey AS VARCHAR(10)), 10, '0')
    WHEN 6 THEN lpad(CAST(p_partkey % 100 AS VARCHAR(3)), 3, '0')
    WHEN 7 THEN '0000' || CAST(20000000 + p_partkey AS VARCHAR(8))
    WHEN 8 THEN CAST(NULL AS VARCHAR(13))
    ELSE '3' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0') END AS ean,
  CASE WHEN o_orderkey % 97 <> 0 THEN p_name END AS description_ean,
  CASE WHEN o_orderkey % 4 = 0 THEN 'F' || CAST(p_size AS VARCHAR(4)) END AS id_famille,
  o_totalprice AS ca,
  o_totalprice / 2 AS ca_prix_qte
FROM orders JOIN part ON p_partkey = o_custkey""",
    "predictions": """
SELECT row_id, label, ca, true_coicop,
  CASE row_id % 5 WHEN 0 THEN '99.9.9.9.9' WHEN 1 THEN substr(true_coicop, 1, 8) || '.9'
    WHEN 2 THEN substr(true_coicop, 1, 4) || '.9.9.9' ELSE true_coicop END AS coicop_predicted
FROM (SELECT o_orderkey AS row_id, p_name AS label, o_totalprice AS ca,
    lpad(CAST(ascii(split_part(p_name, ' ', 2)) % 12 + 1 AS VARCHAR(2)), 2, '0') || '.' ||
    CAST(length(split_part(p_name, ' ', 2)) % 9 + 1 AS VARCHAR(1)) || '.' ||
    CAST(ascii(split_part(p_name, ' ', 1)) % 9 + 1 AS VARCHAR(1)) || '.' ||
    CAST(length(split_part(p_name, ' ', 1)) % 9 + 1 AS VARCHAR(1)) || '.1' AS true_coicop
  FROM orders JOIN part ON p_partkey = o_custkey) t""",
    "nomenclature": """
SELECT DISTINCT n AS code_len, substr(true_coicop, 1, n) AS code,
  'Desc ' || substr(true_coicop, 1, n) || CASE WHEN n = 10 THEN ' n.c.a.' ELSE '' END AS description
FROM (SELECT DISTINCT true_coicop FROM predictions WHERE substr(true_coicop, 1, 2) <> '07') t
  CROSS JOIN (VALUES (2), (4), (6), (8), (10)) AS v(n)""",
    "nomen": """
SELECT CASE code_len WHEN 2 THEN 'division' WHEN 4 THEN 'groupe' WHEN 6 THEN 'classe' WHEN 8 THEN 'sous-classe' ELSE 'poste' END AS level,
  code, description FROM nomenclature""",
    "ean_family": """
SELECT '3' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0') AS ean, 'F' || CAST(p_size AS VARCHAR(4)) AS id_famille
FROM part WHERE p_partkey % 3 = 0""",
    "family_code": """
SELECT DISTINCT 'F' || CAST(p_size AS VARCHAR(4)) AS id_famille,
  CASE WHEN p_size % 10 = 0 THEN '999999' WHEN p_size % 2 = 0 THEN CAST(111111 + p_size AS VARCHAR(6))
    ELSE CAST(11111 + p_size AS VARCHAR(5)) END AS code_coicop_poste
FROM part WHERE p_size % 7 <> 0""",
    "field_survey": """
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 2 = 0 THEN 'BRAND_A' ELSE 'BRAND_B' END AS enseigne,
  '3' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0') AS code_barres, 'VAR' || CAST(p_partkey % 40 AS VARCHAR(2)) AS libelle
FROM part WHERE p_partkey % 5 <> 0""",
    "variety_code": """
SELECT DISTINCT 'DC_VAR' || CAST(p_partkey % 40 AS VARCHAR(2)) AS libvariete,
  CAST(11120 + p_partkey % 40 AS VARCHAR(5)) || '.0' AS idposte FROM part WHERE p_partkey % 40 <> 4""",
    # descriptions of the codes that labelling assigns; codes that end in 3 have none
    "label_nomen": """
SELECT DISTINCT 'poste' AS level, code, 'Desc ' || code || CASE WHEN code LIKE '%2' THEN ' n.c.a.' ELSE '' END AS description
FROM (SELECT substr(d, 1, 2) || '.' || substr(d, 3, 1) || '.' || substr(d, 4, 1) || '.' || substr(d, 5, 1) || '.' || substr(d, 6, 1) AS code
  FROM (SELECT CASE WHEN length(code_coicop_poste) = 5 THEN '0' || code_coicop_poste ELSE code_coicop_poste END AS d FROM family_code
    UNION ALL SELECT '0' || substr(idposte, 1, 5) AS d FROM variety_code) u) v
WHERE code NOT LIKE '%3'""",
    # repeated keys, so that the order of rows decides
    "ean_family_rows": """
SELECT p_partkey AS row_id, '3' || lpad(CAST(p_partkey % 1500 AS VARCHAR(12)), 12, '0') AS ean,
  'F' || CAST(p_size AS VARCHAR(4)) AS id_famille FROM part""",
    "family_code_rows": """
SELECT p_partkey AS row_id, 'F' || CAST(p_size AS VARCHAR(4)) AS id_famille,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(11111 + p_partkey % 9000 AS VARCHAR(5)) ELSE CAST(111111 + p_partkey % 9000 AS VARCHAR(6)) END AS code_coicop_poste
FROM part""",
    "field_survey_rows": """
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 2 = 0 THEN 'BRAND_A' ELSE 'BRAND_B' END AS enseigne,
  '3' || lpad(CAST(p_partkey % 900 AS VARCHAR(12)), 12, '0') AS code_barres, 'VAR' || CAST(p_partkey % 40 AS VARCHAR(2)) AS libelle
FROM part""",
    "variety_code_rows": """
SELECT p_partkey AS row_id, 'DC_VAR' || CAST(p_partkey % 40 AS VARCHAR(2)) AS libvariete,
  CAST(11120 + p_partkey % 77 AS VARCHAR(5)) || '.0' AS idposte FROM part""",
    "nomenclature_rows": """
SELECT o_orderkey AS row_id, CASE o_orderkey % 2 WHEN 0 THEN 'poste' ELSE 'division' END AS level,
  CASE o_orderkey % 2 WHEN 0 THEN '''' || lpad(CAST(o_orderkey % 90 AS VARCHAR(2)), 2, '0') || '.1.1.1.1'
    ELSE '''' || lpad(CAST(o_orderkey % 90 AS VARCHAR(2)), 2, '0') END AS code,
  'Text ' || CAST(o_orderkey AS VARCHAR(12)) AS description
FROM orders""",
    # product labels in the manner of receipts: quantities, units, tags, punctuation, noise
    "raw_labels": """
SELECT o_orderkey AS row_id,
  CASE o_orderkey % 8 WHEN 5 THEN '978' ELSE '376' END || lpad(CAST(o_custkey % 300 AS VARCHAR(10)), 10, '0') AS ean,
  CASE o_orderkey % 24
    WHEN 0 THEN CAST(p_size AS VARCHAR(2)) || ' ' || p_name || ' bio'
    WHEN 1 THEN p_name || ' ' || CAST(p_size AS VARCHAR(2)) || 'x' || CAST(p_size * 10 AS VARCHAR(3)) || 'g'
    WHEN 2 THEN p_name || ', ' || CAST(p_size AS VARCHAR(2)) || '.5kg (promo)'
    WHEN 3 THEN 'lot de ' || CAST(p_size AS VARCHAR(2)) || ' ' || p_name || '*' || CAST(p_size AS VARCHAR(2))
    WHEN 4 THEN 'l''' || p_name || ' ' || CAST(p_size AS VARCHAR(2)) || ' cl'
    WHEN 5 THEN p_name || ' ' || CAST(p_size AS VARCHAR(2)) || 'x' || CAST(p_size + 3 AS VARCHAR(2)) || ' cm'
    WHEN 6 THEN CAST(p_size AS VARCHAR(2)) || '/' || CAST(p_size + 2 AS VARCHAR(2)) || ' ' || p_name
    WHEN 7 THEN p_name || ' & ' || p_type || ' ' || CAST(p_size AS VARCHAR(2)) || '%'
    WHEN 8 THEN 'promo date courte ' || p_name || ' homme xl'
    WHEN 9 THEN p_name || '&amp;' || p_brand || ' fin de serie'
    WHEN 10 THEN p_name || ' ' || CAST(p_size AS VARCHAR(2)) || ' mois aop - ' || CAST(p_size AS VARCHAR(2)) || 'mm'
    WHEN 11 THEN 'inconnu'
    WHEN 12 THEN CAST(3000000 + o_custkey AS VARCHAR(12))
    WHEN 13 THEN p_name || ' 60w ' || CAST(p_size AS VARCHAR(2)) || ' ct s'
    WHEN 14 THEN p_name || ' 38/40 de la femme'
    WHEN 15 THEN 'st wc ' || p_name || ' ab ' || CAST(p_size AS VARCHAR(2)) || 'p'
    WHEN 16 THEN p_name || '!?+;' || p_type
    WHEN 17 THEN 'si'
    WHEN 18 THEN p_name || ' a'
    WHEN 19 THEN p_name || ' ab'
    ELSE p_name END AS label
FROM orders JOIN part ON p_partkey = o_custkey""",
    # labels as receipts print them, with the code of their product
    "coded_labels": """
SELECT r.row_id, r.label, p.true_coicop FROM raw_labels r JOIN predictions p ON r.row_id = p.row_id""",
    "cleaned": """
SELECT row_id, ean_final, description_ean_final, id_famille, ca FROM (
  SELECT o_orderkey AS row_id,
    CASE WHEN o_orderkey % 3 = 0 THEN '3' || lpad(CAST(p_partkey AS VARCHAR(12)), 12, '0')
      WHEN o_orderkey % 3 = 1 THEN lpad(CAST(p_partkey % 500 AS VARCHAR(8)), 8, '0')
      WHEN o_orderkey % 30 = 2 THEN CAST(NULL AS VARCHAR(13))
      ELSE CAST(20000000 + p_partkey % 77 AS VARCHAR(8)) END AS ean_final,
    CASE WHEN o_orderkey % 89 <> 0 THEN upper(p_name) || CASE WHEN p_partkey % 4 = 0 THEN ' ' || CAST(p_partkey % 50 AS VARCHAR(2)) ELSE '' END END AS description_ean_final,
    CASE WHEN o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND p_size > 25) THEN 'F' || CAST(p_size AS VARCHAR(4)) END AS id_famille,
    o_totalprice AS ca
  FROM orders JOIN part ON p_partkey = o_custkey) t""",
    "coded": """
SELECT row_id, ean_final, description_ean_final, id_famille, ca,
  CASE WHEN row_id % 3 <> 0 THEN '01.1.1.1.1' END AS true_coicop FROM cleaned""",
    "tokens_base": """
SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS token,
  CASE WHEN length(split_part(p_name, ' ', 1)) > 3 THEN lower(substr(split_part(p_name, ' ', 1), 1, 3)) ELSE '# ' || split_part(p_name, ' ', 1) END AS base
FROM part WHERE p_partkey % 3 <> 1 OR length(p_name) > 9""",
}

# Which views a view is built on.
NEEDS = {
    "nomenclature": ("predictions",),
    "nomen": ("predictions", "nomenclature"),
    "label_nomen": ("family_code", "variety_code"),
    "coded": ("cleaned",),
    "coded_labels": ("raw_labels", "predictions"),
}


def spread(df: DataFrame) -> DataFrame:
    """A table that is read as fewer partitions than there are cores is dealt out over them.

    The test tables are files with a single row group. Large tables pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_REGISTERED = "contract.sf_dir"


def register(spark: SparkSession, sf_dir: str) -> None:
    if spark.conf.get(_REGISTERED, None) == sf_dir:
        return
    for table in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        (spread(df) if table in FACTS else df).createOrReplaceTempView(table)
    for name, text in VIEWS.items():
        spark.sql(text).createOrReplaceTempView(name)
    spark.conf.set(_REGISTERED, sf_dir)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables of `sf_dir`; names in lower case."""
    register(spark, sf_dir)
    return spark.table(name)


def ctes(*names: str) -> str:
    """The views as common table expressions, in the order of their definition."""
    wanted = set(names)
    for name in names:
        wanted |= set(NEEDS.get(name, ()))
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in wanted)
