"""Check SQL: the same results as `contract.queries`, written independently for DuckDB."""

from __future__ import annotations

from contract.views import ctes
from tillroll.functions.rules import LABEL_RULES
from tillroll.functions.stopwords import FRENCH
from tillroll.functions.text import FOLD_FROM, FOLD_TO, MORE_LETTERS

ORACLE: dict[str, str] = {}


def add(name: str, views: str | tuple[str, ...], sql: str, *more: str) -> None:
    """`more` are common table expressions on top of the views."""
    views = (views,) if isinstance(views, str) else views
    parts = [p for p in (ctes(*views), *more) if p]
    ORACLE[name] = f"WITH RECURSIVE {', '.join(parts)}\n{sql}" if parts else sql


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# sources and sinks

add(
    "read_receipts",
    "receipts",
    """SELECT row_id AS ROW_ID, ean AS EAN, description_ean AS DESCRIPTION_EAN, id_famille AS ID_FAMILLE,
    ca AS CA, ca_prix_qte AS CA_PRIX_QTE FROM receipts""",
)
add("read_labelled", "coded", "SELECT * FROM coded WHERE true_coicop IS NOT NULL")
add(
    "nomenclature",
    "nomenclature_rows",
    """SELECT level, replace(code, '''', '') AS code, arg_max(description, row_id) AS description
    FROM nomenclature_rows GROUP BY 1, 2""",
)
add(
    "ean_family_table",
    "ean_family_rows",
    "SELECT ean, arg_max(id_famille, row_id) AS id_famille FROM ean_family_rows GROUP BY 1",
)


def dotted(digits: str) -> str:
    padded = f"(CASE WHEN length({digits}) = 5 THEN '0' || {digits} ELSE {digits} END)"
    return f"(substr({padded}, 1, 2) || regexp_replace(substr({padded}, 3), '(.)', '.\\1', 'g'))"


def undecimal(code: str) -> str:
    return f"(CASE WHEN {code} LIKE '%.0' THEN replace({code}, '.0', '') ELSE {code} END)"


add(
    "family_code_table",
    "family_code_rows",
    f"""SELECT id_famille, arg_max({dotted('code_coicop_poste')}, row_id) AS code
    FROM family_code_rows GROUP BY 1""",
)
add(
    "field_survey_table",
    "field_survey_rows",
    """SELECT code_barres AS EAN_FINAL, arg_min(libelle, row_id) AS LABEL_VARIETE FROM field_survey_rows
    WHERE enseigne = 'BRAND_A' AND row_id % 50 <> 0 GROUP BY 1""",
)
VARIETY = f"""SELECT replace(libvariete, 'DC_', '') AS LABEL_VARIETE,
  arg_min({dotted(undecimal('idposte'))}, {{order}}) AS COICOP_FIELD FROM {{table}} GROUP BY 1"""
add("variety_code_table", "variety_code_rows", VARIETY.format(order="row_id", table="variety_code_rows"))
add(
    "labelled_lines",
    "coded",
    "SELECT row_id, '__label__' || true_coicop || ' ' || description_ean_final AS line FROM coded",
)
add(
    "parse_labelled_lines",
    "coded",
    """SELECT description_ean_final AS text FROM coded
    WHERE true_coicop IS NOT NULL AND description_ean_final IS NOT NULL""",
)
add("strip_label_prefix", "predictions", "SELECT row_id, coicop_predicted AS pred FROM predictions")

# barcodes

NORM = """norm AS (
  SELECT row_id AS ROW_ID, e AS EAN, description_ean AS DESCRIPTION_EAN, id_famille AS ID_FAMILLE, ca AS CA,
    ca_prix_qte AS CA_PRIX_QTE,
    CASE WHEN length(e) > 13 AND NOT regexp_matches(pre, '^550+2') THEN right(e, 13)
      WHEN length(e) > 8 AND regexp_matches(pre, '^(55)?0+2') THEN right(e, 8) ELSE e END AS EAN_CLEAN
  FROM (SELECT *, CASE WHEN length(e) > 7 THEN substr(e, 1, length(e) - 7) ELSE '' END AS pre
    FROM (SELECT *, trim(ean) AS e FROM receipts) t) u)"""
REPAIRED = """repaired AS (
  SELECT n.*, CASE WHEN length(EAN_CLEAN) IN (8, 13) OR length(EAN_CLEAN) < 4 OR found IS NULL THEN EAN_CLEAN
    ELSE found END AS EAN_RECONSTRUCTED
  FROM norm n JOIN (SELECT DESCRIPTION_EAN AS d,
      arg_min(EAN_CLEAN, ROW_ID) FILTER (WHERE length(EAN_CLEAN) IN (8, 13)) AS found
    FROM norm WHERE EAN_CLEAN IS NOT NULL GROUP BY 1) g ON d = DESCRIPTION_EAN
  WHERE EAN_CLEAN IS NOT NULL)"""
add("trim_ean", "receipts", "SELECT row_id, trim(ean) AS ean FROM receipts")
add("normalise_ean", "receipts", "SELECT ROW_ID, EAN, EAN_CLEAN FROM norm", NORM)
add(
    "split_valid_ean",
    "receipts",
    "SELECT ROW_ID, EAN_CLEAN, coalesce(length(EAN_CLEAN) NOT IN (8, 13), true) AS EAN_REMOVE FROM norm",
    NORM,
)
add("reconstruct_ean", "receipts", "SELECT ROW_ID, EAN_CLEAN, EAN_RECONSTRUCTED FROM repaired", NORM, REPAIRED)
add(
    "clean_ean",
    "receipts",
    """SELECT ROW_ID, DESCRIPTION_EAN, ID_FAMILLE, CA, CA_PRIX_QTE, EAN_RECONSTRUCTED AS EAN_FINAL
    FROM repaired WHERE length(EAN_RECONSTRUCTED) IN (8, 13)""",
    NORM,
    REPAIRED,
)
add(
    "reconstruct_ean_lcs",
    "receipts",
    """SELECT ROW_ID, EAN_CLEAN, coalesce(found, EAN_CLEAN) AS EAN_RECONSTRUCTED
    FROM kept LEFT JOIN best ON best.d = DESCRIPTION_EAN AND best.bad = EAN_CLEAN""",
    NORM,
    "kept AS (SELECT * FROM norm WHERE EAN_CLEAN IS NOT NULL AND DESCRIPTION_EAN IS NOT NULL)",
    """pieces AS (SELECT DISTINCT e, substr(e, a, 1) || substr(e, b, 1) || substr(e, c, 1) || substr(e, d, 1) AS piece
      FROM (SELECT DISTINCT EAN_CLEAN AS e FROM kept) t,
        range(1, 20) r1(a), range(1, 20) r2(b), range(1, 20) r3(c), range(1, 20) r4(d)
      WHERE a < b AND b < c AND c < d AND d <= length(e))""",
    """pairs AS (SELECT DESCRIPTION_EAN AS d, EAN_CLEAN AS e, min(ROW_ID) AS first FROM kept GROUP BY 1, 2)""",
    """best AS (SELECT b.d, b.e AS bad, arg_min(s.e, s.first) AS found
      FROM pairs b JOIN pieces pb ON pb.e = b.e JOIN pieces ps ON ps.piece = pb.piece
        JOIN pairs s ON s.d = b.d AND s.e = ps.e
      WHERE length(b.e) NOT IN (8, 13) AND length(s.e) IN (8, 13) AND pb.piece <> '0000' GROUP BY 1, 2)""",
)

# descriptions

WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def rules_sql(label: str, masked: bool = True) -> str:
    out = label
    for pattern, to in LABEL_RULES:
        mask = f"regexp_matches({label}, {text(pattern)})"
        if "(?!" in pattern:  # the look-ahead refuses numbers followed by "/" before the next blank
            pattern = r"^\d+\b"
            mask = f"(regexp_matches({label}, {text(pattern)}) AND NOT regexp_matches({label}, '^\\d+\\S*/'))"
        put = f"CASE WHEN {mask} THEN {text(to)} ELSE '\\0' END" if masked else text(to)
        out = f"regexp_replace({out}, {text(pattern)}, {put}, 'g')"
    return out


def no_stopwords(label: str) -> str:
    stop = ", ".join(text(w) for w in FRENCH)
    return f"array_to_string(list_filter({WORDS.format(label)}, lambda w: w NOT IN ({stop})), ' ')"


def no_short_words(label: str) -> str:
    shielded = f"regexp_replace({label}, '\\b(ST|WC)\\b', '\\1QQQQ', 'g')"
    return f"replace(regexp_replace({shielded}, '\\b\\w{{1,2}}\\b', '', 'g'), 'QQQQ', '')"


def one_space(label: str) -> str:
    return f"regexp_replace({label}, ' {{2,}}', ' ', 'g')"


def braces(sql: str) -> str:
    """Shield braces from a later format()."""
    return sql.replace("{", "{{").replace("}", "}}")


def labels_query(name: str, expr: str) -> None:
    add(name, "raw_labels", f"SELECT row_id, {expr} AS label FROM (SELECT row_id, upper(label) AS o FROM raw_labels) t")


add(
    "drop_editions",
    "raw_labels",
    "SELECT *, false AS Edition FROM raw_labels WHERE substr(ean, 1, 3) NOT IN ('378', '977', '978', '979')",
)
add("upper_label", (), "SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS text FROM documents")
labels_query("apply_label_rules", rules_sql("o"))
labels_query("apply_label_rules_sequential", rules_sql("o", masked=False))
add("collapse_spaces", (), f"SELECT doc_id, {one_space('''replace(text, ' e', '   e')''')} AS text FROM documents")
labels_query("remove_stopwords", no_stopwords("o"))
FOLDED = f"translate(text, {text(FOLD_FROM)}, {text(FOLD_TO)})"
for letter, plain in MORE_LETTERS.items():
    FOLDED = f"replace({FOLDED}, {text(letter)}, {text(plain)})"
add("fold_ascii", (), f"SELECT doc_id, {FOLDED} AS text FROM documents")
add("strip_digits", (), "SELECT doc_id, regexp_replace(text, '[0-9]', '', 'g') AS text FROM documents")
labels_query("drop_short_words", no_short_words("o"))
BASE_FORMS = f"""forms AS (
  SELECT row_id, regexp_replace(upper(string_agg(coalesce(base, w), ' ' ORDER BY pos)), '#\\s', '#', 'g') AS form
  FROM (SELECT row_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
    FROM (SELECT row_id, {WORDS.format('cleaned')} AS ws FROM texts) t) u LEFT JOIN tokens_base ON token = w
  GROUP BY 1)"""
add(
    "normalise_tokens",
    ("raw_labels", "tokens_base"),
    "SELECT row_id, coalesce(form, '') AS label FROM texts LEFT JOIN forms USING (row_id)",
    "texts AS (SELECT row_id, upper(label) AS cleaned FROM raw_labels)",
    BASE_FORMS,
)
TEXTS = (
    "texts AS MATERIALIZED (SELECT row_id, "
    + braces(one_space(no_short_words("regexp_replace(s, '[0-9]', '', 'g')")))
    + " AS cleaned FROM (SELECT row_id, "
    + braces(no_stopwords(one_space("r")))
    + " AS s FROM (SELECT row_id, "
    + braces(rules_sql("o"))
    + " AS r FROM (SELECT row_id, upper({label}) AS o FROM {rows}"
    " WHERE substr({ean}, 1, 3) NOT IN ('378', '977', '978', '979')) t) u) v)"
)
add("drop_short_labels", "raw_labels", "SELECT * FROM raw_labels WHERE length(label) >= 3")
add(
    "clean_label",
    ("raw_labels", "tokens_base"),
    """SELECT row_id AS ROW_ID, ean AS EAN_FINAL, form AS DESCRIPTION_EAN_FINAL
    FROM raw_labels JOIN forms USING (row_id) WHERE length(form) >= 3""",
    TEXTS.format(label="label", ean="ean", rows="raw_labels"),
    BASE_FORMS,
)
add("keep_columns", "receipts", "SELECT ean AS EAN, description_ean AS DESCRIPTION_EAN, ca AS CA FROM receipts")

# The longest common subsequence by bit vectors: the zeros left in `v` count its length.
ALIKE = """neighbours AS MATERIALIZED (
    SELECT row_id AS this, label AS a, lead(row_id) OVER w AS that, lead(label) OVER w AS b
    FROM {rows} WINDOW w AS (PARTITION BY ean ORDER BY row_id)),
  kinds AS MATERIALIZED (SELECT DISTINCT a, b FROM neighbours WHERE b IS NOT NULL),
  steps AS (
    SELECT a, b, 1 AS i, CAST(pow(2, length(b)) AS HUGEINT) - 1 AS v FROM kinds
    UNION ALL
    SELECT a, b, i + 1, ((v + u) | (v - u)) & (CAST(pow(2, length(b)) AS HUGEINT) - 1)
    FROM (SELECT a, b, i, v, v & CAST(list_sum([CASE WHEN substr(b, j, 1) = substr(a, i, 1)
        THEN CAST(pow(2, j - 1) AS HUGEINT) ELSE CAST(0 AS HUGEINT) END for j in range(1, length(b) + 1)]) AS HUGEINT) AS u
      FROM steps WHERE i <= length(a)) t),
  alike AS MATERIALIZED (SELECT a, b FROM steps WHERE i = length(a) + 1
    AND 200.0 * (length(b) - bit_count(v)) / (length(a) + length(b)) > 75),
  losers AS MATERIALIZED (SELECT DISTINCT CASE WHEN length(a) > length(b) THEN that ELSE this END AS row_id
    FROM neighbours JOIN alike USING (a, b))"""
add(
    "drop_similar_labels",
    "raw_labels",
    "SELECT * FROM raw_labels WHERE row_id NOT IN (SELECT row_id FROM losers)",
    ALIKE.format(rows="raw_labels"),
)
add(
    "cleaning_report",
    ("raw_labels", "tokens_base"),
    """SELECT 'edition' AS step, (SELECT count(*) FROM raw_labels) - (SELECT count(*) FROM books) AS rows_removed
    UNION ALL SELECT 'short', (SELECT count(*) FROM books) - (SELECT count(*) FROM raw_labels JOIN forms USING (row_id)
      WHERE length(form) >= 3)""",
    TEXTS.format(label="label", ean="ean", rows="raw_labels"),
    BASE_FORMS,
    "books AS (SELECT * FROM raw_labels WHERE substr(ean, 1, 3) NOT IN ('378', '977', '978', '979'))",
)

# labelling

add(
    "lookup",
    ("cleaned", "ean_family"),
    """SELECT row_id AS ROW_ID, ean_final AS EAN_FINAL, f.id_famille AS FAMILY
    FROM cleaned LEFT JOIN ean_family f ON f.ean = ean_final""",
)
COLUMNS = "row_id AS ROW_ID, ean_final AS EAN_FINAL, description_ean_final AS DESCRIPTION_EAN_FINAL, ca AS CA"
FILLED = """filled AS (SELECT c.row_id, ean_final, description_ean_final, ca, coalesce(c.id_famille, f.id_famille) AS id_famille
  FROM cleaned c LEFT JOIN ean_family f ON f.ean = ean_final WHERE ean_final IS NOT NULL)"""
SPREAD = """spread AS (SELECT row_id, ean_final, description_ean_final, ca, coalesce(id_famille, only_one) AS id_famille
  FROM {rows} JOIN (SELECT description_ean_final AS d, CASE WHEN count(DISTINCT id_famille) = 1 THEN min(id_famille) END AS only_one
    FROM {rows} GROUP BY 1) g ON d = description_ean_final)"""
add(
    "fill_family_from_ean",
    ("cleaned", "ean_family"),
    f"SELECT {COLUMNS}, id_famille AS ID_FAMILLE FROM filled",
    FILLED,
)
add(
    "propagate_family_by_label",
    "cleaned",
    f"SELECT {COLUMNS}, id_famille AS ID_FAMILLE FROM spread",
    SPREAD.format(rows="cleaned"),
)
add(
    "format_code",
    ("family_code_rows", "variety_code_rows"),
    f"""SELECT row_id, {dotted('code_coicop_poste')} AS family_code, {dotted(undecimal('idposte'))} AS survey_code
    FROM family_code_rows JOIN variety_code_rows USING (row_id)""",
)
DESCRIBED = "described AS (SELECT code, replace(description, ' n.c.a.', '') AS description FROM label_nomen)"
FROM_FAMILY = f"""from_family AS (SELECT r.*, code AS family_coicop, description AS family_desc
  FROM {{rows}} r LEFT JOIN (SELECT id_famille, {dotted('code_coicop_poste')} AS code FROM family_code) f USING (id_famille)
    LEFT JOIN described USING (code))"""
VARIETIES = f"varieties AS ({VARIETY.format(order='idposte', table='variety_code')})"
FROM_FIELD = """from_field AS (SELECT r.*, libelle AS label_variete, COICOP_FIELD AS coicop_field, description AS desc_field
  FROM {rows} r LEFT JOIN (SELECT code_barres, libelle FROM field_survey WHERE enseigne = 'BRAND_A') s ON code_barres = ean_final
    LEFT JOIN varieties ON LABEL_VARIETE = libelle LEFT JOIN described ON code = COICOP_FIELD)"""
LABELLED = """labelled AS (SELECT *, coalesce(family_coicop, coicop_field) AS true_coicop,
    coalesce(family_desc, desc_field) AS true_desc,
    CASE WHEN family_coicop <> coicop_field THEN coicop_field END AS conflict,
    CASE WHEN family_coicop <> coicop_field THEN desc_field END AS conflict_desc FROM from_field)"""
TABLES = ("cleaned", "ean_family", "family_code", "field_survey", "variety_code", "label_nomen")
ALL_STEPS = (
    FILLED,
    SPREAD.format(rows="filled"),
    DESCRIBED,
    VARIETIES,
    FROM_FAMILY.format(rows="spread"),
    FROM_FIELD.format(rows="from_family"),
    LABELLED,
)
BOTH_CODES = (DESCRIBED, VARIETIES, FROM_FAMILY.format(rows="cleaned"), FROM_FIELD.format(rows="from_family"), LABELLED)
add(
    "code_from_family",
    ("cleaned", "family_code", "variety_code", "label_nomen"),
    f"""SELECT {COLUMNS}, id_famille AS ID_FAMILLE, family_coicop AS TRUE_COICOP, family_desc AS DESC_COICOP_TRUE
    FROM from_family""",
    DESCRIBED,
    FROM_FAMILY.format(rows="cleaned"),
)
add(
    "describe_code",
    ("predictions", "nomen"),
    """SELECT row_id, coicop_predicted, replace(n.description, ' n.c.a.', '') AS description
    FROM predictions LEFT JOIN (SELECT * FROM nomen WHERE level = 'poste') n ON n.code = coicop_predicted""",
)
add(
    "code_from_field_survey",
    TABLES,
    f"""SELECT {COLUMNS}, id_famille AS ID_FAMILLE, label_variete AS LABEL_VARIETE, coicop_field AS COICOP_FIELD,
    desc_field AS DESC_COICOP_FIELD FROM from_field""",
    DESCRIBED,
    VARIETIES,
    FROM_FIELD.format(rows="cleaned"),
)
add(
    "flag_code_conflicts",
    TABLES,
    """SELECT row_id AS ROW_ID, family_coicop AS TRUE_COICOP, conflict AS TRUE_COICOP_CONFLICT,
    conflict_desc AS DESC_COICOP_TRUE_CONFLICT FROM labelled""",
    *BOTH_CODES,
)
add(
    "fill_code_from_survey",
    TABLES,
    "SELECT row_id AS ROW_ID, true_coicop AS TRUE_COICOP, true_desc AS DESC_COICOP_TRUE FROM labelled",
    *BOTH_CODES,
)
add(
    "labelling_report",
    TABLES,
    """SELECT n AS rows, before AS families_before, fams AS families_after, fams - before AS families_added,
      codes AS labels_from_family, round(codes / fams, 6) AS family_rate, scope AS out_of_scope, fresh AS field_new,
      same AS field_equal, differ AS field_conflict, round((fresh + same + differ) / matched, 6) AS field_rate,
      round(done / n, 6) AS labelled_share
    FROM (SELECT count(*) AS n, (SELECT count(id_famille) FROM cleaned) AS before, count(id_famille) AS fams,
      count(family_coicop) AS codes, count(*) FILTER (WHERE family_coicop = '99.9.9.9.9') AS scope,
      count(*) FILTER (WHERE true_coicop IS NOT NULL AND id_famille IS NULL) AS fresh,
      count(*) FILTER (WHERE id_famille IS NOT NULL AND coicop_field = true_coicop) AS same,
      count(conflict) AS differ, count(label_variete) AS matched, count(true_coicop) AS done FROM labelled) t""",
    *ALL_STEPS,
)
add(
    "unmatched_varieties",
    TABLES,
    """SELECT DISTINCT label_variete AS LABEL_VARIETE FROM labelled
    WHERE coicop_field IS NULL AND label_variete IS NOT NULL""",
    *ALL_STEPS,
)
add(
    "label_receipts",
    TABLES,
    f"""SELECT {COLUMNS}, id_famille AS ID_FAMILLE, true_coicop AS TRUE_COICOP, true_desc AS DESC_COICOP_TRUE,
    conflict AS TRUE_COICOP_CONFLICT, conflict_desc AS DESC_COICOP_TRUE_CONFLICT FROM labelled""",
    *ALL_STEPS,
)

# statistics


def histogram(name: str, sizes: str) -> None:
    add(
        name,
        "cleaned",
        """SELECT bucket, n, round(n / (SELECT count(*) FROM sizes), 6) AS share FROM (
        SELECT CASE WHEN size > 9 THEN '10+' ELSE CAST(size AS VARCHAR) END AS bucket, count(*) AS n FROM sizes GROUP BY 1) t""",
        f"sizes AS ({sizes})",
    )


for name, column in (("ean", "ean_final"), ("label", "description_ean_final")):
    histogram(
        f"{name}_occurrence_histogram",
        f"SELECT count(*) AS size FROM cleaned WHERE {column} IS NOT NULL GROUP BY {column}",
    )
for name, group, column in (
    ("labels_per_ean_histogram", "ean_final", "description_ean_final"),
    ("eans_per_label_histogram", "description_ean_final", "ean_final"),
):
    histogram(
        name,
        f"""SELECT count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) AS size
        FROM cleaned WHERE {group} IS NOT NULL GROUP BY {group}""",
    )
MONEY = "CAST(ca AS DECIMAL(18, 2))"


def summary_line(name: str, test: str) -> str:
    return f"""SELECT '{name}' AS metric, count(*) FILTER (WHERE {test}) AS n,
      round(count(*) FILTER (WHERE {test}) / count(*), 6) AS row_share,
      round(CAST(coalesce(sum({MONEY}) FILTER (WHERE {test}), 0) AS DOUBLE) / CAST(sum({MONEY}) AS DOUBLE), 6) AS revenue_share FROM coded"""


add(
    "receipt_summary",
    "coded",
    f"""SELECT 'rows' AS metric, count(*) AS n, CAST(NULL AS DOUBLE) AS row_share, CAST(NULL AS DOUBLE) AS revenue_share FROM coded
    UNION ALL SELECT 'eans', count(*), NULL, NULL FROM (SELECT DISTINCT ean_final FROM coded) t
    UNION ALL SELECT 'labels', count(*), NULL, NULL FROM (SELECT DISTINCT description_ean_final FROM coded) t
    UNION ALL {summary_line('known_code', 'true_coicop IS NOT NULL')}
    UNION ALL {summary_line('length_8', 'length(ean_final) = 8')}
    UNION ALL {summary_line('length_13', 'length(ean_final) = 13')}
    UNION ALL {summary_line('questionable', "ean_final LIKE '0%'")}""",
)

# hierarchy

CUTS = [f"left(true_coicop, greatest(length(true_coicop) - {2 * k}, 0)) AS cut_{k}" for k in range(6)]
add("truncate_code", "predictions", f"SELECT row_id, {', '.join(CUTS)} FROM predictions")
add(
    "hierarchy_columns",
    "coded",
    """SELECT description_ean_final AS DESCRIPTION_EAN_FINAL, left(true_coicop, 2) AS DIVISION,
    left(true_coicop, 4) AS GROUPE, left(true_coicop, 6) AS CLASSE, left(true_coicop, 8) AS "SOUS-CLASSE",
    true_coicop AS POSTE FROM coded WHERE true_coicop IS NOT NULL""",
)
LEVEL_NAME = """CASE length({0}) WHEN 2 THEN 'Division' WHEN 4 THEN 'Groupe' WHEN 6 THEN 'Classe'
  WHEN 8 THEN 'Sous-classe' WHEN 10 THEN 'Poste' ELSE '0' END"""
add(
    "code_level_name",
    "nomenclature",
    f"""SELECT code, {LEVEL_NAME.format('code')} AS level_name,
    {LEVEL_NAME.format('left(code, length(code) - 1)')} AS shorter_name FROM nomenclature""",
)
STEPS = "(VALUES (0, 'poste'), (1, 'sous-classe'), (2, 'classe'), (3, 'groupe'), (4, 'division')) AS s(level_no, level)"
LEVELS = f"""levels AS (SELECT row_id, ca, level, level_no,
    left(true_coicop, 10 - 2 * level_no) AS true_coicop, left(coicop_predicted, 10 - 2 * level_no) AS coicop_predicted
  FROM predictions CROSS JOIN {STEPS})"""
add("explode_levels", "predictions", "SELECT * EXCLUDE (ca) FROM levels", LEVELS)

# classification


def unit_hash(key: str, seed: str) -> str:
    """The first eight hex digits of md5(key || seed) as a number."""
    digit = f"(instr('0123456789abcdef', substr(md5(CAST({key} AS VARCHAR) || {seed}), i, 1)) - 1)"
    return f"CAST(list_sum([{digit} * CAST(pow(16, 8 - i) AS BIGINT) for i in range(1, 9)]) AS BIGINT)"


def held_out(key: str, seed: str = "'42'") -> str:
    return f"({unit_hash(key, seed)} < {int(0.2 * 2**32)})"


def split_cte(columns: str, source: str, key: str) -> str:
    return f"parted AS MATERIALIZED (SELECT {columns}, {held_out(key)} AS test FROM {source})"


FLAT_EDGES = "SELECT {by} '' AS parent, code AS child, text FROM train"
TREE_EDGES = " UNION ALL ".join(
    f"SELECT {{by}} left(code, {n - 2}) AS parent, left(code, {n}) AS child, text FROM train" for n in (2, 4, 6, 8, 10)
)
LEVEL_EDGES = " UNION ALL ".join(
    f"SELECT {{by}} '{name}' AS parent, left(code, {n}) AS child, text FROM train"
    for name, n in (("poste", 10), ("sous-classe", 8), ("classe", 6), ("groupe", 4), ("division", 2))
)


def model(edges: str, by: str = "", cut: str = WORDS) -> str:
    """Tables of a model over train(by, code, text); `by` ends in a comma when given."""
    return f"""edge AS MATERIALIZED ({edges.format(by=by)}),
  children AS MATERIALIZED (SELECT {by} parent, child, count(*) AS n_c FROM edge GROUP BY ALL),
  parents AS (SELECT {by} parent, sum(n_c) AS n_p FROM children GROUP BY ALL),
  seen AS (SELECT {by} parent, child, unnest({cut.format('text')}) AS t FROM edge),
  counts AS MATERIALIZED (SELECT {by} parent, child, t, count(*) AS n FROM seen GROUP BY ALL),
  totals AS (SELECT {by} parent, child, sum(n) AS total FROM counts GROUP BY ALL),
  vocab AS MATERIALIZED (SELECT DISTINCT {by} parent, t FROM counts),
  sizes AS (SELECT {by} parent, count(*) AS v FROM vocab GROUP BY ALL),
  node AS MATERIALIZED (SELECT {by} parent, child, ln(n_c / n_p) AS prior, coalesce(total, 0) + coalesce(v, 1) AS base
    FROM children JOIN parents USING ({by} parent) LEFT JOIN totals USING ({by} parent, child)
      LEFT JOIN sizes USING ({by} parent))"""


def predictions(items: str, by: str = "", out: str = "pred", cut: str = WORDS) -> str:
    """`out`(by, text, parent, child, confidence, margin) for the distinct rows of `items`."""
    return f"""{out}_words AS (SELECT {by} parent, text, unnest({cut.format('text')}) AS t FROM {items}),
  {out}_known AS (SELECT {by} parent, text, t, count(*) AS tf FROM {out}_words JOIN vocab USING ({by} parent, t) GROUP BY ALL),
  {out}_sums AS (SELECT {by} parent, text, child, sum(tf * ln((coalesce(n, 0) + 1) / base)) AS s
    FROM {out}_known JOIN node USING ({by} parent) LEFT JOIN counts USING ({by} parent, child, t) GROUP BY ALL),
  {out}_scores AS (SELECT {by} parent, text, child, round(prior + coalesce(s, 0), 6) AS score
    FROM {items} JOIN node USING ({by} parent) LEFT JOIN {out}_sums USING ({by} parent, text, child)),
  {out}_ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} parent, text ORDER BY score DESC, child) AS place,
      max(score) OVER (PARTITION BY {by} parent, text) AS top FROM {out}_scores),
  {out} AS MATERIALIZED (SELECT {by} parent, text, max(child) FILTER (WHERE place = 1) AS child,
      round(1 / sum(exp(score - top)), 6) AS confidence,
      round((1 - coalesce(max(exp(score - top)) FILTER (WHERE place = 2), 0)) / sum(exp(score - top)), 6) AS margin
    FROM {out}_ranked GROUP BY ALL)"""


PARTED = split_cte("row_id, label, ca, true_coicop", "predictions", "row_id")
TRAIN = "train AS (SELECT true_coicop AS code, label AS text FROM parted WHERE NOT test)"
TEST = "items AS (SELECT DISTINCT '' AS parent, label AS text FROM parted WHERE test)"
FLAT = (PARTED, TRAIN, TEST, model(FLAT_EDGES), predictions("items"))
add(
    "train_test_split",
    "predictions",
    "SELECT row_id, CASE WHEN test THEN 'test' ELSE 'train' END AS part FROM parted",
    PARTED,
)
add(
    "flat_classifier",
    "predictions",
    """SELECT row_id, label, ca, true_coicop, child AS FLAT_PRED, confidence AS CONFIDENCE
    FROM parted JOIN pred ON text = label WHERE test""",
    *FLAT,
)

def ngrams_of(column: str) -> str:
    """Runs of one to three words and, after #, three to six characters of <word>."""
    ws = WORDS.format(column)
    runs = [
        f"list_transform(range(1, len({ws}) - {n - 2}), lambda i: array_to_string(list_slice({ws}, i, i + {n - 1}), ' '))"
        for n in (1, 2, 3)
    ]
    chars = [
        f"""flatten(list_transform({ws}, lambda w: list_transform(range(1, length(w) + {4 - k}),
          lambda j: '#' || substr('<' || w || '>', j, {k}))))"""
        for k in (3, 4, 5, 6)
    ]
    return f"flatten([{', '.join(runs + chars)}])"


NGRAMS = ngrams_of("{0}")
add(
    "flat_classifier_ngrams",
    "predictions",
    """SELECT row_id, label, ca, true_coicop, child AS FLAT_PRED, confidence AS CONFIDENCE
    FROM parted JOIN pred ON text = label WHERE test""",
    PARTED,
    TRAIN,
    TEST,
    model(FLAT_EDGES, cut=NGRAMS),
    predictions("items", cut=NGRAMS),
)
add(
    "predict_distinct",
    ("predictions", "nomen"),
    """SELECT row_id, label, ca, true_coicop, child AS COICOP_PREDICTED,
      replace(n.description, ' n.c.a.', '') AS DESC_COICOP_PRED
    FROM parted JOIN pred ON text = label LEFT JOIN nomen n ON n.level = 'poste' AND n.code = child WHERE test""",
    *FLAT,
)
ORACLE["kept_model"] = ORACLE["flat_classifier"]
add(
    "flat_classifier_unseen_labels",
    "coded_labels",
    """SELECT row_id, label, true_coicop, child AS FLAT_PRED, confidence AS CONFIDENCE
    FROM parted JOIN pred ON text = label WHERE test""",
    split_cte("row_id, label, true_coicop", "coded_labels", "label"),
    "train AS (SELECT true_coicop AS code, label AS text FROM parted WHERE NOT test)",
    TEST,
    model(FLAT_EDGES),
    predictions("items"),
)
add(
    "flat_classifier_documents",
    (),
    """SELECT doc_id, lang, child AS FLAT_PRED, confidence AS CONFIDENCE
    FROM parted p JOIN pred ON pred.text = p.text WHERE test""",
    split_cte("doc_id, text, lang", "documents", "doc_id"),
    "train AS (SELECT lang AS code, text FROM parted WHERE NOT test)",
    "items AS (SELECT DISTINCT '' AS parent, text FROM parted WHERE test)",
    model(FLAT_EDGES),
    predictions("items"),
)
add(
    "lcpn_training_sets",
    "predictions",
    """SELECT CASE WHEN parent = '' THEN 'division' ELSE parent END AS parent,
      CASE WHEN parent = '' THEN child ELSE right(child, 1) END AS child, text FROM edge""",
    "train AS (SELECT true_coicop AS code, label AS text FROM predictions)",
    f"edge AS ({TREE_EDGES.format(by='')})",
)
add(
    "lcpn_model_count",
    "predictions",
    """SELECT sum(n)::BIGINT AS models FROM (SELECT count(DISTINCT left(true_coicop, k)) AS n
      FROM predictions CROSS JOIN (VALUES (2), (4), (6), (8)) AS v(k) GROUP BY k) t""",
)


def route(by: str = "") -> list[str]:
    """Tables at0 to at4: the node each text has reached after a level."""
    steps, reached = [], "items"
    for step in range(5):
        steps.append(predictions(reached, by, f"l{step}"))
        reached = f"at{step}"
        steps.append(f"at{step} AS MATERIALIZED (SELECT {by} text, child AS parent FROM l{step})")
    return steps


def way(kind: str, by: str) -> list[str]:
    """Model and table pred(by, text, child) of the flat or the top-down classifier."""
    if kind == "flat":
        return [model(FLAT_EDGES, by), predictions("items", by)]
    return [model(TREE_EDGES, by), *route(by), f"pred AS (SELECT {by} text, parent AS child FROM at4)"]


ROUTE = route()
add(
    "lcpn_classifier",
    "predictions",
    """SELECT label, arg_min(row_id, row_id) AS row_id, arg_min(ca, row_id) AS ca, arg_min(true_coicop, row_id) AS true_coicop,
      any_value(parent) AS LCPN_PRED FROM parted JOIN at4 ON text = label WHERE test AND length(parent) = 10 GROUP BY label""",
    PARTED,
    TRAIN,
    TEST,
    model(TREE_EDGES),
    *ROUTE,
)
NAMES = ("POSTE", "SOUS-CLASSE", "CLASSE", "GROUPE", "DIVISION")
WIDE = ", ".join(
    f"""max(child) FILTER (WHERE parent = '{n.lower()}') AS "{n}_PRED",
    max(margin) FILTER (WHERE parent = '{n.lower()}') AS "DIFF_PROB_{n}\""""
    for n in NAMES
)


def backoff(threshold: float) -> str:
    steps = [f'CASE WHEN "DIFF_PROB_{n}" > {threshold} THEN "{n}_PRED" END' for n in NAMES]
    return f"coalesce({', '.join(steps)}, '')"


add(
    "lcpl_classifier",
    "predictions",
    f"""SELECT p.row_id, label, ca, true_coicop, wide.* EXCLUDE (text), {backoff(0.5)} AS CONFIDENCE_PRED
    FROM parted p JOIN wide ON text = label WHERE test""",
    PARTED,
    TRAIN,
    "items AS (SELECT DISTINCT lower(name) AS parent, label AS text FROM parted CROSS JOIN "
    f"(VALUES {', '.join(f'({text(n)})' for n in NAMES)}) AS v(name) WHERE test)",
    model(LEVEL_EDGES),
    predictions("items"),
    f"wide AS (SELECT text, {WIDE} FROM pred GROUP BY text)",
)
MARGINS = ", ".join(
    f"""left(coicop_predicted, {10 - 2 * k}) AS "{n}_PRED", ((row_id * {k + 3}) % 10) / 10.0 AS "DIFF_PROB_{n}\""""
    for k, n in enumerate(NAMES)
)
add(
    "backoff_prediction",
    "predictions",
    f"SELECT row_id, {backoff(0.65)} AS CONFIDENCE_PRED FROM (SELECT row_id, {MARGINS} FROM predictions) t",
)


def scores(by: str, pairs: str = "pairs") -> str:
    """weighted(by, precision, recall, f1, support) and shared(by, precision, recall, f1) of pairs(by, t, p, n)."""
    ancestors = "[left({0}, k) for k in [2, 4, 6, 8, 10]]"
    common = f"length(list_intersect({ancestors.format('t')}, {ancestors.format('p')}))"
    return f"""actual AS (SELECT {by} t AS c, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp FROM {pairs} GROUP BY ALL),
  claimed AS (SELECT {by} p AS c, sum(n) AS predicted FROM {pairs} GROUP BY ALL),
  per_class AS (SELECT {by} support, coalesce(tp / predicted, 0) AS pr, tp / support AS re
    FROM actual LEFT JOIN claimed USING ({by} c)),
  weighted AS (SELECT {by} round(sum(pr * support) / sum(support), 6) AS precision, round(sum(re * support) / sum(support), 6) AS recall,
    round(sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * support) / sum(support), 6) AS f1,
    sum(support)::BIGINT AS support FROM per_class GROUP BY ALL),
  shared AS (SELECT {by} round(sum({common} * n) / sum(5 * n), 6) AS precision, round(sum({common} * n) / sum(5 * n), 6) AS recall,
    round(sum({common} * n) / sum(5 * n), 6) AS f1 FROM {pairs} GROUP BY ALL)"""


for name, kind in (("repeated_holdout", "flat"), ("repeated_holdout_lcpn", "lcpn")):
    add(
        name,
        "predictions",
        """SELECT count(*) AS splits, round(avg(w.precision), 6) AS flat_precision, round(avg(w.recall), 6) AS flat_recall,
          round(avg(w.f1), 6) AS flat_f1, round(avg(s.precision), 6) AS hier_precision, round(avg(s.recall), 6) AS hier_recall,
          round(avg(s.f1), 6) AS hier_f1 FROM weighted w JOIN shared s USING (split)""",
        f"""parted AS MATERIALIZED (SELECT split, true_coicop, label, {held_out('row_id', 'CAST(split AS VARCHAR)')} AS test
          FROM predictions CROSS JOIN (VALUES (42), (43), (44), (45), (46)) AS v(split))""",
        "train AS (SELECT split, true_coicop AS code, label AS text FROM parted WHERE NOT test)",
        "items AS (SELECT DISTINCT split, '' AS parent, label AS text FROM parted WHERE test)",
        *way(kind, "split,"),
        """pairs AS (SELECT p.split, true_coicop AS t, child AS p, count(*) AS n
          FROM parted p JOIN pred ON pred.split = p.split AND text = label WHERE test GROUP BY ALL)""",
        scores("split,"),
    )
BY_HASH = unit_hash("row_id", "'42'") + " % 5 + 1"
for name, kind, fold in (
    ("kfold_scores", "flat", BY_HASH),
    ("kfold_scores_lcpn", "lcpn", BY_HASH),
    ("kfold_scores_contiguous", "flat", "ntile(5) OVER (ORDER BY row_id)"),
):
    add(
        name,
        "predictions",
        "SELECT fold, precision, recall, f1, support FROM weighted",
        f"held AS MATERIALIZED (SELECT {fold} AS fold, true_coicop, label FROM predictions)",
        """train AS (SELECT f.fold, true_coicop AS code, label AS text
          FROM held h JOIN (SELECT DISTINCT fold FROM held) f ON f.fold <> h.fold)""",
        "items AS (SELECT DISTINCT fold, '' AS parent, label AS text FROM held)",
        *way(kind, "fold,"),
        """pairs AS (SELECT h.fold, true_coicop AS t, child AS p, count(*) AS n
          FROM held h JOIN pred ON pred.fold = h.fold AND text = label GROUP BY ALL)""",
        scores("fold,"),
    )
RUNS = [
    f"unnest([array_to_string(list_slice(ws, i, i + {n - 1}), ' ') for i in range(1, length(ws) - {n - 2})]) AS gram"
    for n in (1, 2, 3)
]
add(
    "text_features",
    "raw_labels",
    f"""SELECT kind, gram AS ngram, sum(n)::BIGINT AS n, {unit_hash('gram', "''")} % 1000000 AS bucket FROM grams GROUP BY ALL""",
    f"""pieces AS (SELECT row_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
      FROM (SELECT row_id, {WORDS.format('label')} AS ws FROM raw_labels) t)""",
    "known AS (SELECT w, count(*) AS n FROM pieces GROUP BY 1 HAVING count(*) >= 3)",
    "kept AS (SELECT row_id, list(w ORDER BY pos) AS ws FROM pieces WHERE w IN (SELECT w FROM known) GROUP BY 1)",
    f"""grams AS (
      {' UNION ALL '.join(f"SELECT 'word' AS kind, {run}, 1 AS n FROM kept" for run in RUNS)}
      UNION ALL SELECT 'char', unnest([substr('<' || w || '>', i, k) for i in range(1, length(w) + 4 - k)]), n
      FROM known CROSS JOIN (VALUES (3), (4), (5), (6)) AS v(k))""",
)
add(
    "tfidf_features",
    "raw_labels",
    """SELECT label, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY label)), 6) AS tfidf FROM (
      SELECT label, term, tf * (ln((1 + (SELECT count(*) FROM raw_labels)) / (1 + df)) + 1) AS w
      FROM (SELECT label, term, count(*) AS tf FROM terms GROUP BY ALL) t JOIN frequencies USING (term)) u""",
    "tokens AS (SELECT DISTINCT label, regexp_extract_all(lower(label), '\\w\\w+') AS ws FROM raw_labels)",
    """terms AS (SELECT label, unnest(ws) AS term FROM tokens
      UNION ALL SELECT label, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, length(ws))]) FROM tokens)""",
    """frequencies AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT label, term FROM terms) d
      JOIN raw_labels USING (label) GROUP BY 1 HAVING count(*) <= 0.2 * (SELECT count(*) FROM raw_labels))""",
)

# evaluation

PAIRS = "pairs AS (SELECT true_coicop AS t, coicop_predicted AS p, count(*) AS n FROM predictions GROUP BY ALL)"
add("classification_metrics", "predictions", "SELECT * FROM weighted", PAIRS, scores(""))
add("flat_metrics", "predictions", "SELECT precision, recall, f1 FROM weighted", PAIRS, scores(""))
add("hierarchical_metrics", "predictions", "SELECT * FROM shared", PAIRS, scores(""))
add(
    "revenue_weighted_metrics",
    "predictions",
    """SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM sums""",
    f"""sums AS (SELECT CAST(coalesce(sum({MONEY}) FILTER (WHERE true_coicop = coicop_predicted), 0) AS DOUBLE) AS tp,
      CAST(coalesce(sum({MONEY}) FILTER (WHERE true_coicop <> coicop_predicted), 0) AS DOUBLE) AS fn,
      CAST(coalesce(sum({MONEY}) FILTER (WHERE true_coicop <> coicop_predicted
        AND coicop_predicted IN (SELECT true_coicop FROM predictions)), 0) AS DOUBLE) AS fp FROM predictions)""",
)
add(
    "accuracy_by_level",
    "predictions",
    f"""SELECT level, 6 - level_no AS digits,
      round(count(*) FILTER (WHERE true_coicop = coicop_predicted) / count(*), 6) AS row_share,
      round(CAST(coalesce(sum({MONEY}) FILTER (WHERE true_coicop = coicop_predicted), 0) AS DOUBLE) / CAST(sum({MONEY}) AS DOUBLE), 6)
        AS revenue_share FROM levels GROUP BY ALL""",
    LEVELS,
)

# reports

NAMED = "named AS (SELECT level, code, replace(description, ' n.c.a.', '') AS description FROM nomen)"
ACCURACY = f"""accuracy AS (
  SELECT true_coicop AS COICOP, hits AS NB_CORRECT_PRED, n AS NB_OCCURENCE, hits / n AS FREQ_CORRECT_PRED,
    description AS COICOP_DESC, {LEVEL_NAME.format('true_coicop')} AS CATEGORY
  FROM (SELECT level, true_coicop, count(*) FILTER (WHERE true_coicop = coicop_predicted) AS hits, count(*) AS n
    FROM levels GROUP BY ALL) t JOIN named ON named.level = t.level AND code = true_coicop WHERE hits > 0)"""
SANKEY = f"""sankey AS (
  SELECT a.description AS source, b.description || ' ' AS target, n AS value, {LEVEL_NAME.format('true_coicop')} AS CATEGORY
  FROM (SELECT level, true_coicop, coicop_predicted, count(*) AS n FROM levels GROUP BY ALL) t
    LEFT JOIN named a ON a.level = t.level AND a.code = true_coicop
    LEFT JOIN named b ON b.level = t.level AND b.code = coicop_predicted)"""
FLOWS = """flows AS (SELECT coalesce(source, 'Non suivi') AS source, coalesce(target, 'Non suivi') AS target, value
  FROM sankey WHERE CATEGORY = 'Poste')"""


def report(name: str, sql: str, *more: str) -> None:
    add(name, ("predictions", "nomen"), sql, LEVELS, NAMED, *more)


report("accuracy_table", "SELECT * FROM accuracy", ACCURACY)
report("write_report", "SELECT * FROM accuracy", ACCURACY)
report("sankey_table", "SELECT * FROM sankey", SANKEY)
report(
    "confusion_matrix",
    """SELECT t AS "true", p AS pred, coalesce(n, 0)::DOUBLE AS nb, a.description AS desc_true, b.description AS desc_pred,
      left(t, 4) AS true_short, g.description AS desc_groupe
    FROM (SELECT DISTINCT true_coicop AS t FROM predictions) x CROSS JOIN (SELECT DISTINCT coicop_predicted AS p FROM predictions) y
      LEFT JOIN pairs USING (t, p) LEFT JOIN named a ON a.level = 'poste' AND a.code = t
      LEFT JOIN named b ON b.level = 'poste' AND b.code = p LEFT JOIN named g ON g.level = 'groupe' AND g.code = left(t, 4)""",
    PAIRS,
)
report(
    "confusion_pairs",
    """SELECT t AS "true", p AS pred, n::DOUBLE AS nb, round(n / sum(n) OVER (PARTITION BY t), 6)::DOUBLE AS share,
      a.description AS desc_true, b.description AS desc_pred, left(t, 4) AS true_short, g.description AS desc_groupe
    FROM pairs LEFT JOIN named a ON a.level = 'poste' AND a.code = t
      LEFT JOIN named b ON b.level = 'poste' AND b.code = p LEFT JOIN named g ON g.level = 'groupe' AND g.code = left(t, 4)""",
    PAIRS,
)
report("overall_accuracy", "SELECT round(sum(NB_CORRECT_PRED) / sum(NB_OCCURENCE), 6) AS accuracy FROM accuracy", ACCURACY)
TOP = "SELECT COICOP, COICOP_DESC, NB_OCCURENCE, FREQ_CORRECT_PRED FROM accuracy WHERE CATEGORY = "
report("top_codes", TOP + "'Poste' ORDER BY NB_OCCURENCE DESC, COICOP LIMIT 10", ACCURACY)
report("top_codes_by_rate", TOP + "'Sous-classe' ORDER BY FREQ_CORRECT_PRED, COICOP LIMIT 20", ACCURACY)
report("sankey_flows", "SELECT * FROM flows", SANKEY, FLOWS)
report("sankey_sources", "SELECT DISTINCT source FROM flows", SANKEY, FLOWS)
report("flows_of", "SELECT * FROM flows WHERE source = 'Non suivi'", SANKEY, FLOWS)
report(
    "column_range",
    """SELECT min(NB_OCCURENCE) AS min_size, max(NB_OCCURENCE) AS max_size, min(FREQ_CORRECT_PRED) AS min_rate,
    max(FREQ_CORRECT_PRED) AS max_rate FROM accuracy WHERE CATEGORY = 'Classe'""",
    ACCURACY,
)

# whole jobs

add(
    "clean_and_label",
    (*[t for t in TABLES if t != "cleaned"], "receipts", "tokens_base"),
    f"""SELECT {COLUMNS}, CA_PRIX_QTE, l.id_famille AS ID_FAMILLE, true_coicop AS TRUE_COICOP, true_desc AS DESC_COICOP_TRUE,
    conflict AS TRUE_COICOP_CONFLICT, conflict_desc AS DESC_COICOP_TRUE_CONFLICT
    FROM labelled l JOIN (SELECT row_id AS key, ca_prix_qte AS CA_PRIX_QTE FROM receipts) x ON key = l.row_id""",
    NORM,
    REPAIRED,
    TEXTS.format(
        label="DESCRIPTION_EAN",
        ean="EAN_RECONSTRUCTED",
        rows="(SELECT * FROM repaired WHERE length(EAN_RECONSTRUCTED) IN (8, 13)) valid",
    ),
    BASE_FORMS,
    """cleaned AS MATERIALIZED (SELECT r.row_id, EAN_RECONSTRUCTED AS ean_final, form AS description_ean_final,
      ID_FAMILLE AS id_famille, CA AS ca FROM repaired r JOIN forms f ON f.row_id = r.row_id WHERE length(form) >= 3)""",
    *ALL_STEPS,
)
ROUTED = (
    PARTED,
    TRAIN,
    TEST,
    model(TREE_EDGES),
    *ROUTE,
    """routed AS (SELECT arg_min(row_id, row_id) AS row_id, arg_min(true_coicop, row_id) AS true_coicop, any_value(parent) AS coicop_predicted
      FROM parted JOIN at4 ON text = label WHERE test AND length(parent) = 10 GROUP BY label)""",
    LEVELS.replace("ca, ", "").replace("FROM predictions", "FROM routed"),
    NAMED,
)
add("predict_and_report", ("predictions", "nomen"), "SELECT * FROM accuracy", *ROUTED, ACCURACY)
add("report_flows", ("predictions", "nomen"), "SELECT * FROM sankey", *ROUTED, SANKEY)
add(
    "report_scores",
    ("predictions", "nomen"),
    """SELECT 'flat' AS kind, precision, recall, f1 FROM weighted
    UNION ALL SELECT 'hierarchical', precision, recall, f1 FROM shared""",
    *ROUTED,
    PAIRS.replace("FROM predictions", "FROM routed"),
    scores(""),
)
