"""The driver's queries over an adapter view of ``lineitem``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactweave.functions import ordering
from contactweave.functions.fields import named
from contactweave.functions.graph import shared_folder, written
from contactweave.model import Header, Pairs
from contactweave.operators import basic, binning, dedup, routing, stats
from contactweave.operators.process import numbered
from contactweave.sources.pairs import as_lines, typed_lines
from contactweave.streaming.duplicates import DuplicateStream

CHROMS = [f"chr{i}" for i in range(1, 13)]
SIZES = dict.fromkeys(CHROMS, 1_000_000)

LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: Columns that decide places only; the view doesn't name them.
TIES = ("l_discount", "l_tax", "l_shipdate")
NUMBERED = f"SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_COLUMNS)}) AS seq FROM lineitem"
VIEW = """
WITH l AS ({lines}),
s AS (SELECT CAST(seq AS BIGINT) AS seq, 'r' || CAST(seq AS STRING) AS readID,
  CASE WHEN l_suppkey % 25 = 0 THEN '!' ELSE 'chr' || CAST(l_suppkey % 12 + 1 AS STRING) END AS ca,
  CASE WHEN l_suppkey % 25 = 0 AND l_linenumber = 7 THEN '!'
       WHEN seq % 4 = 0 THEN 'chr' || CAST(l_partkey % 12 + 1 AS STRING)
       WHEN l_suppkey % 25 = 0 THEN 'chr1'
       ELSE 'chr' || CAST(l_suppkey % 12 + 1 AS STRING) END AS cb,
  l_partkey % 1000 + 1 AS na, l_orderkey % 1000 + 1 AS nb,
  l_partkey * 1009 % 1000000 + 1 AS wa, CAST(round(l_extendedprice * 100) AS BIGINT) % 1000000 + 1 AS wb,
  CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS sa, CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS sb,
  CAST(l_quantity AS INT) AS mapq1, l_linenumber * 9 AS mapq2,
  CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'U' END AS tb FROM l)
SELECT seq, readID, ca AS chrom1, CASE WHEN ca='!' THEN 0 ELSE {p}a END AS pos1,
       cb AS chrom2, CASE WHEN cb='!' THEN 0 ELSE {p}b END AS pos2,
       CASE WHEN ca='!' THEN '-' ELSE sa END AS strand1, CASE WHEN cb='!' THEN '-' ELSE sb END AS strand2,
       (CASE WHEN ca='!' THEN 'N' ELSE 'U' END) || (CASE WHEN cb='!' THEN 'N' ELSE tb END) AS pair_type,
       mapq1, mapq2 FROM s"""
#: Numbered tables by application, folder, and the names, sizes and times of its files.
_numbered: dict[tuple, DataFrame] = {}


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's columns of ``lineitem`` with ``seq``, a row's place in the order of all
    columns; worked out once per table and application."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    key = spark.sparkContext.applicationId, sf_dir, tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    if key not in _numbered:
        _numbered[key] = ordering.ranked(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(LINE_COLUMNS), LINE_COLUMNS, "seq", [c for c in LINE_COLUMNS if c not in TIES])
    return _numbered[key]


def pairs(spark: SparkSession, sf_dir: str, flavour: str) -> DataFrame:
    """The adapter view, with narrow (``n``) or wide (``w``) positions."""
    return spark.sql(VIEW.format(lines="SELECT * FROM {lines}", p=flavour), lines=lines(spark, sf_dir))


def rank(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(readID, sort_rank); only the sort keys and names are dealt and written."""
    keys = basic.sort_keys(df, extra)
    return ordering.ranked(df.select("readID", *keys), keys, "sort_rank", ["readID"])


def sort_rank(spark, sf_dir):
    return rank(pairs(spark, sf_dir, "w"))


def flip(spark, sf_dir):
    return basic.flip_pairs(pairs(spark, sf_dir, "w"), CHROMS[:8]).drop("seq")


SELECTS = {
    "select_uu_close": ('(pair_type == "UU") and (abs(pos1-pos2) < 1000)', "pair_type = 'UU' AND abs(pos1 - pos2) < 1000"),
    "select_mapq": ("mapq1 >= 30 and mapq2 >= 30", "mapq1 >= 30 AND mapq2 >= 30"),
    "select_regex": ('regex_match(chrom1, "chr1[0-2]?")', "regexp_full_match(chrom1, 'chr1[0-2]?')"),
    "select_wildcard": ('wildcard_match(pair_type, "U*")', "pair_type LIKE 'U%'"),
    "select_csv": ('csv_match(pair_type, "UU,UR")', "pair_type IN ('UU', 'UR')"),
    "select_in": ("chrom1 in ['chr1', 'chr2'] and chrom2 not in ['chr3']", "chrom1 IN ('chr1', 'chr2') AND chrom2 <> 'chr3'"),
    "select_chained": ("1000 < pos1 <= 500000 < pos2", "1000 < pos1 AND pos1 <= 500000 AND 500000 < pos2"),
    "select_arith": ("(pos1 - pos2) // 1000 % 3 == 1", "((CAST(floor((pos1 - pos2) / 1000.0) AS BIGINT) % 3) + 3) % 3 = 1"),
    "select_place": ("COLS[2] % 2 == 0 and COLS[1] == 'chr3'", "pos1 % 2 = 0 AND chrom1 = 'chr3'"),
    "select_truth": ("pos1 and not (chrom2 == '!') or mapq1 - 10", "pos1 <> 0 AND chrom2 <> '!' OR mapq1 - 10 <> 0"),
    "select_substring": ("'1' in chrom1 and '2' not in chrom2", "contains(chrom1, '1') AND NOT contains(chrom2, '2')"),
    "select_concat": ("chrom1 + ':' + chrom2 == 'chr2:chr2' || pair_type + '&&' == 'NN&&'", "chrom1 || ':' || chrom2 = 'chr2:chr2' OR pair_type = 'NN'"),
    "select_quotient": ("mapq1 / mapq2 > 1.5", "CAST(mapq1 AS DOUBLE) / mapq2 > 1.5"),
    "select_sign": ("-mapq1 + +mapq2 >= -3 && !(strand1 == '+')", "mapq2 - mapq1 >= -3 AND strand1 <> '+'"),
    "select_int": ("int(mapq1 / 2) == 7 or int('12') == mapq2", "mapq1 // 2 = 7 OR mapq2 = 12"),
    "select_float": ("float('2.5e1') < float(mapq1)", "mapq1 > 25.0"),
    "select_power": ("mapq1 ** 2 > mapq2 ** 2 + 2 ** 10 and 3 ** 35 == 50031545098999707", "mapq1 * mapq1 > mapq2 * mapq2 + 1024"),
    "select_word": (r"regex_match(chrom1, '\bchr\d\b')", "regexp_full_match(chrom1, 'chr[0-9]')"),
    "select_mixed": ("(pair_type == 'UU' and chrom1 or mapq1) in ['chr2', 7, 'chr5'] or (mapq2 - 9 and pair_type) == 0", "CASE WHEN pair_type = 'UU' THEN chrom1 IN ('chr2', 'chr5') ELSE mapq1 = 7 END OR mapq2 = 9"),
    "select_negative_power": ("mapq1 ** (mapq2 // 9 - 3) < 0.01 or (mapq2 ** (3 - mapq2 // 9)) == 324", "CAST(mapq1 AS DOUBLE) ** (mapq2 // 9 - 3) < 0.01 OR CAST(mapq2 AS DOUBLE) ** (3 - mapq2 // 9) = 324"),
    "select_str_float": ("str(pos1 / 8) == '25000.125' or '.375' in str(pos2 / 8) or str(mapq1 / 1e6) == '3.1e-05'", "pos1 = 200001 OR pos2 % 8 = 3 OR mapq1 = 31"),
    "select_minmax": ("max(pos1, pos2) - min(pos1, pos2) > 10000 or len(readID) == 4", "greatest(pos1, pos2) - least(pos1, pos2) > 10000 OR strlen(readID) = 4"),
}


def selection(name: str):
    def query(spark, sf_dir):
        return basic.select_pairs(pairs(spark, sf_dir, "w"), SELECTS[name][0])[0].drop("seq")

    query.__name__ = name
    return query


RAW_CONDITION = ('pos1 > 500000 and chrom2 != "chr3" and mapq1 % 2 == 1', "pos1 > 500000 AND chrom2 <> 'chr3' AND mapq1 % 2 = 1")
RAW_LINE = " || chr(9) || ".join(["readID", "chrom1", "lpad(CAST(pos1 AS STRING), 9, '0')", "chrom2", "lpad(CAST(pos2 AS STRING), 9, '0')", "strand1", "strand2", "pair_type || 'x'", "'+' || CAST(mapq1 AS STRING)", "'+' || CAST(mapq2 AS STRING)", "readID || ' '", "''"])


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter view as lines with padded numbers, signs, blanks and a tail, read as
    rows that carry them."""
    header = Header.standard(SIZES)
    header.append_columns(["mapq1", "mapq2"])
    lines = pairs(spark, sf_dir, "w").select(F.expr(RAW_LINE).alias("line"), "seq")
    return typed_lines(lines, header)


def select_raw(spark, sf_dir):
    kept, _ = basic.select_pairs(raw_rows(spark, sf_dir), RAW_CONDITION[0])
    return as_lines(kept, named(kept))


def flip_raw(spark, sf_dir):
    flipped = basic.flip_pairs(raw_rows(spark, sf_dir), CHROMS[:8])
    return as_lines(flipped, named(flipped))


def select_rest(spark, sf_dir):
    return basic.select_pairs(pairs(spark, sf_dir, "w"), SELECTS["select_uu_close"][0])[1].drop("seq")


def select_chrom_subset(spark, sf_dir):
    return basic.select_pairs(pairs(spark, sf_dir, "w"), "True", chrom_subset=["chr1", "chr2", "chr3"])[0].drop("seq")


def type_cast(spark, sf_dir):
    """readID read from a string: its digits as a number."""
    df = pairs(spark, sf_dir, "w").withColumn("digits", F.expr("substring(readID, 2)"))
    return basic.select_pairs(df, "digits % 7 == 3", {"digits": "int"})[0].select("readID", "digits")


def classes(spark, sf_dir):
    return stats.with_classes(pairs(spark, sf_dir, "w"))


def stats_counters(spark, sf_dir):
    return stats.counters(classes(spark, sf_dir))


def stats_pair_types(spark, sf_dir):
    return stats.pair_types(classes(spark, sf_dir))


def stats_chrom_freq(spark, sf_dir):
    return stats.chrom_freq(classes(spark, sf_dir))


def stats_dist_freq(spark, sf_dir):
    return stats.dist_freq(classes(spark, sf_dir))


def stats_summary(spark, sf_dir):
    row = stats.counters(classes(spark, sf_dir)).first().asDict()
    rates = stats.summary(row)
    return spark.createDataFrame([(k, float(v)) for k, v in rates.items() if k != "complexity_naive"], "name string, value double")


def stats_convergence(spark, sf_dir):
    freq = {(r["bin"], r["direction"]): r["n"] for r in stats.dist_freq(classes(spark, sf_dir)).collect()}
    found = stats.convergence(freq, stats.bin_edges())
    return spark.createDataFrame([(k, str(v)) for k, v in found.items()], "name string, value string")


#: Columns that neither orders, clusters, counters nor bins read; tables that are written
#: on the way leave them out, as Spark does where nothing is written.
UNREAD = ("readID", "mapq1", "mapq2")


def marked(spark, sf_dir):
    rows = dedup.mark_duplicates(pairs(spark, sf_dir, "n").drop(*UNREAD))
    return written(rows.withColumn("dup", F.col("outcome") == "dup"), "marked")


def stats_dups(spark, sf_dir):
    """Counters where near duplicates are marked."""
    return stats.counters(stats.with_classes(marked(spark, sf_dir)))


def stats_dups_summary(spark, sf_dir):
    """Share of duplicates, and the library's complexity to ten digits."""
    rates = stats.summary(stats.counters(stats.with_classes(marked(spark, sf_dir))).first().asDict())
    return spark.createDataFrame([(k, float(f"{rates[k]:.10g}")) for k in ("frac_dups", "complexity_naive")], "name string, value double")


def dedup_parents(spark, sf_dir):
    """Duplicates as DD with the reads that they repeat, kept reads with their own."""
    df = pairs(spark, sf_dir, "n")
    out = routing.route(Pairs(Header.standard(SIZES), df), "main", "main", keep_parent_id=True)
    return out.main.df.select("readID", "pair_type", F.get("_rest", F.lit(0)).alias("parent_readID"))


def sort_extra(spark, sf_dir):
    """Rank by the sort keys and two more columns."""
    df = pairs(spark, sf_dir, "n").withColumn("mapq1", F.col("mapq1").cast("string"))
    return rank(df, ["mapq1", "strand2"])


def sort_no_type(spark, sf_dir):
    return rank(pairs(spark, sf_dir, "n").drop("pair_type"))


def remove_columns(spark, sf_dir):
    df = pairs(spark, sf_dir, "w").drop("seq")
    return basic.without_columns(Pairs(Header.standard(SIZES, df.columns), df), ["mapq1", "strand1", "none"]).df


def bin_counters(spark, sf_dir):
    """Counts of rows by what becomes of them, with chromosomes unlisted and too short."""
    sizes = {c: 600_000 for c in CHROMS[:9]}
    got = binning.bin_counters(pairs(spark, sf_dir, "w"), sizes, [100_000], ["UU", "UR"], 5)
    return spark.createDataFrame([(k, n) for k, n in got.items()], "name string, n long")


def dedup_query(name: str, flavour: str = "n", **options):
    def query(spark, sf_dir):
        return dedup.mark_duplicates(pairs(spark, sf_dir, flavour), **options).select("readID", "outcome", "parent")

    query.__name__ = name
    return query


def dedup_stream(spark, sf_dir, slices: int = 3):
    """Near duplicates of the sorted pairs, which arrive in ``slices`` lots of files; of a
    cluster the first row of the table stays, as in ``dedup_max3``."""
    folder = shared_folder(spark, "stream")
    rows = pairs(spark, sf_dir, "n").drop("mapq1", "mapq2", "pair_type")
    rows = written(rows.orderBy(*basic.sort_keys(rows)).withColumn("part", F.shiftright(F.monotonically_increasing_id(), ordering.ROW_BITS)), "sorted")
    lot = F.expr(f"least({slices - 1}, part * {slices} div {int(spark.conf.get('spark.sql.shuffle.partitions'))})")
    stream = DuplicateStream(folder)
    for k in range(slices):
        # Ranges of the sort may be fewer than partitions, never more.
        rows.where(lot == k).drop("part").write.mode("append").parquet(f"{folder}/arrived")
        stream.start(spark.readStream.schema(rows.drop("part").schema).parquet(f"{folder}/arrived")).awaitTermination()
    stream.finish(spark)
    return stream.outcomes(spark).select("readID", "outcome", "parent")


def bin_coo_10k(spark, sf_dir):
    return binning.bin_contacts(binning.accepted(pairs(spark, sf_dir, "w")), SIZES, [10_000]).drop("resolution")


def bin_multi_res(spark, sf_dir):
    return binning.bin_contacts(binning.accepted(pairs(spark, sf_dir, "w")), SIZES, [5_000, 50_000, 250_000])


def bin_filtered(spark, sf_dir):
    return binning.bin_contacts(binning.accepted(pairs(spark, sf_dir, "w"), ["UU"], 20), SIZES, [100_000]).drop("resolution")


def bin_bg2(spark, sf_dir):
    df = pairs(spark, sf_dir, "w")
    sizes = dict.fromkeys(CHROMS, 950_000)
    return binning.bedgraph(binning.bin_contacts(binning.accepted(df), sizes, [100_000]), binning.bin_table(df, sizes, 100_000))


def bin_table(spark, sf_dir):
    return binning.bin_table(spark.range(1), dict.fromkeys(CHROMS, 950_000), 100_000)


def process_fused(spark, sf_dir):
    """Flip, mark duplicates, and bin the pairs that stay."""
    # Written, as the join's keys would else repeat the flip's expressions.
    flipped = written(basic.flip_pairs(pairs(spark, sf_dir, "n"), CHROMS), "pairs")
    kept = dedup.mark_duplicates(flipped, max_mismatch=0).where("outcome = 'kept'")
    return binning.bin_contacts(binning.accepted(kept), SIZES, [100]).drop("resolution")


def process_max3(spark, sf_dir):
    """The whole run with the operators' defaults: flip, sort, mark near duplicates,
    count all rows and bin the pairs that stay.  (part, name, bin1_id, bin2_id, n):
    a counter, or a contact of two bins."""
    rows = dedup.mark_duplicates(numbered(basic.flip_pairs(pairs(spark, sf_dir, "n").drop(*UNREAD), CHROMS)))
    rows = written(rows.withColumn("dup", F.col("outcome") == "dup"), "processed")
    counts = stats.counters(stats.with_classes(rows))
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in counts.columns))).alias("c")
    none = F.lit(None).cast("long")
    counters = counts.select(named).select(F.lit("counter").alias("part"), "c.name", none.alias("bin1_id"), none.alias("bin2_id"), "c.n")
    contacts = binning.bin_contacts(binning.accepted(rows.where("outcome = 'kept'")), SIZES, [100])
    return counters.unionByName(contacts.select(F.lit("contact").alias("part"), F.lit(None).cast("string").alias("name"), "bin1_id", "bin2_id", F.col("count").alias("n")))


def generated(spark, sf_dir):
    return basic.generate_pairs(spark).drop("seq")


QUERIES = {f.__name__: f for f in (sort_rank, select_raw, flip_raw, select_rest, select_chrom_subset, type_cast, stats_counters, stats_pair_types, stats_chrom_freq, stats_dist_freq, stats_summary, stats_convergence, stats_dups, stats_dups_summary, dedup_parents, dedup_stream, sort_extra, sort_no_type, remove_columns, bin_counters, bin_coo_10k, bin_multi_res, bin_filtered, bin_bg2, bin_table, process_fused, process_max3, generated)}
QUERIES |= {"flip_pairs": flip} | {n: selection(n) for n in SELECTS}
QUERIES |= {
    n: dedup_query(n, **o)
    for n, o in {
        "dedup_exact": {"max_mismatch": 0},
        "dedup_max3": {"max_mismatch": 3},
        "dedup_max10k": {"flavour": "w", "max_mismatch": 10_000},
        "dedup_sum8k": {"flavour": "w", "max_mismatch": 8_000, "metric": "sum"},
        "dedup_sum5": {"max_mismatch": 5, "metric": "sum"},
        "dedup_extra_cols": {"max_mismatch": 3, "extra_pairs": [("mapq1", "mapq2")]},
        "dedup_greedy": {"max_mismatch": 3, "clustering": "greedy"},
    }.items()
}

_W, _N = VIEW.format(lines=NUMBERED, p="w"), VIEW.format(lines=NUMBERED, p="n")
_COLUMNS = "readID, chrom1, pos1, chrom2, pos2, strand1, strand2, pair_type, mapq1, mapq2"
_EDGES = "(SELECT unnest([" + ", ".join(map(str, stats.bin_edges())) + "]) AS e)"
_MAPPED = "chrom1 <> '!' AND chrom2 <> '!'"


def _flip_sql(source: str, n: int) -> str:
    place = lambda c: "CASE " + c + " WHEN '!' THEN 0 " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(CHROMS[:n], 1)) + " END"
    return f"""(SELECT seq, readID, CASE WHEN f THEN chrom2 ELSE chrom1 END AS chrom1, CASE WHEN f THEN pos2 ELSE pos1 END AS pos1, CASE WHEN f THEN chrom1 ELSE chrom2 END AS chrom2,
 CASE WHEN f THEN pos1 ELSE pos2 END AS pos2, CASE WHEN f THEN strand2 ELSE strand1 END AS strand1, CASE WHEN f THEN strand1 ELSE strand2 END AS strand2,
 CASE WHEN f THEN reverse(pair_type) ELSE pair_type END AS pair_type, CASE WHEN f THEN mapq2 ELSE mapq1 END AS mapq1, CASE WHEN f THEN mapq1 ELSE mapq2 END AS mapq2
 FROM (SELECT *, CASE WHEN e1 IS NOT NULL AND e2 IS NOT NULL THEN e1 > e2 OR (e1 = e2 AND pos1 > pos2) WHEN e1 IS NOT NULL THEN FALSE WHEN e2 IS NOT NULL THEN TRUE ELSE NOT chrom1 < chrom2 END AS f
 FROM (SELECT *, {place('chrom1')} AS e1, {place('chrom2')} AS e2 FROM ({source}))))"""


def _transitive_sql(reach: str, extra: str = "", source: str = _N) -> str:
    return f"""WITH RECURSIVE p AS MATERIALIZED ({source}), m AS MATERIALIZED (SELECT * FROM p WHERE {_MAPPED}),
u AS MATERIALIZED (SELECT chrom1, chrom2, strand1, strand2, pos1, pos2{extra}, min(seq) AS f FROM m GROUP BY ALL),
e AS MATERIALIZED (SELECT a.f AS a, b.f AS b FROM u a JOIN u b USING (chrom1, chrom2, strand1, strand2{extra}) WHERE {reach}),
c AS (SELECT f, f AS root FROM u UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.f WHERE c.root < e.b),
r AS (SELECT f, min(root) AS root FROM c GROUP BY f),
x AS (SELECT m.seq, r.root FROM m JOIN u USING (chrom1, chrom2, strand1, strand2, pos1, pos2{extra}) JOIN r USING (f))
SELECT readID, CASE WHEN root IS NULL THEN 'unmapped' WHEN root = seq THEN 'kept' ELSE 'dup' END AS outcome, CASE WHEN root <> seq THEN root END AS parent FROM p LEFT JOIN x USING (seq)"""


def _bins_sql(source: str, res: str, size: int) -> str:
    place = lambda c, p: f"((CAST(substr({c}, 4) AS BIGINT) - 1) * (({size} + r - 1) // r) + least(({p} - 1) // r, ({size} + r - 1) // r - 1))"
    return f"""SELECT r AS resolution, least(x, y) AS bin1_id, greatest(x, y) AS bin2_id, count(*) AS count FROM (SELECT r, {place('chrom1', 'pos1')} AS x, {place('chrom2', 'pos2')} AS y
 FROM {source}, (SELECT unnest([{res}]) AS r) WHERE {_MAPPED} AND pos1 > 0 AND pos2 > 0) GROUP BY ALL"""


def _classes_sql(source: str) -> str:
    return f"""(SELECT *, CAST(chrom1 <> '!' AS INT) + CAST(chrom2 <> '!' AS INT) AS sides, {_MAPPED} AND NOT dup AS counted, {_MAPPED} AND NOT dup AND chrom1 = chrom2 AS cis, abs(pos2 - pos1) AS d FROM ({source}))"""


def _counters_sql(classes: str) -> str:
    near = ", ".join(f"count(*) FILTER (cis AND d >= {1000 * k}) AS cis_{k}kb" for k in stats.CIS_KB)
    return f"SELECT count(*) AS total, count(*) FILTER (sides = 0) AS total_unmapped, count(*) FILTER (sides = 1) AS total_single_sided_mapped, count(*) FILTER (sides = 2) AS total_mapped, count(*) FILTER (sides = 2 AND dup) AS total_dups, count(*) FILTER (counted) AS total_nodups, count(*) FILTER (cis) AS cis, count(*) FILTER (counted AND NOT cis) AS trans, {near} FROM {classes}"


_CLASSES = _classes_sql(f"SELECT *, FALSE AS dup FROM ({_W})")
_COUNTERS = _counters_sql(_CLASSES)
_MAX3 = _transitive_sql("abs(a.pos1 - b.pos1) <= 3 AND abs(a.pos2 - b.pos2) <= 3")
_DUPS = _counters_sql(_classes_sql(f"SELECT n.*, o.outcome = 'dup' AS dup FROM ({_N}) n JOIN ({_MAX3}) o USING (readID)"))

ORACLE_SQL = {
    "sort_rank": f"SELECT readID, row_number() OVER (ORDER BY chrom1, chrom2, pos1, pos2, pair_type, seq) AS sort_rank FROM ({_W})",
    "flip_pairs": f"SELECT {_COLUMNS} FROM {_flip_sql(_W, 8)}",
    **{n: f"SELECT {_COLUMNS} FROM ({_W}) WHERE {sql}" for n, (_, sql) in SELECTS.items()},
    "select_raw": f"SELECT {RAW_LINE} AS value FROM ({_W}) WHERE {RAW_CONDITION[1]}",
    "flip_raw": f"SELECT {RAW_LINE} AS value FROM {_flip_sql(_W, 8)}",
    "select_rest": f"SELECT {_COLUMNS} FROM ({_W}) WHERE NOT ({SELECTS['select_uu_close'][1]})",
    "select_chrom_subset": f"SELECT {_COLUMNS} FROM ({_W}) WHERE chrom1 IN ('chr1', 'chr2', 'chr3') AND chrom2 IN ('chr1', 'chr2', 'chr3')",
    "type_cast": f"SELECT readID, substr(readID, 2) AS digits FROM ({_W}) WHERE CAST(substr(readID, 2) AS BIGINT) % 7 = 3",
    "stats_counters": _COUNTERS,
    "stats_pair_types": f"SELECT pair_type, count(*) AS n FROM ({_W}) GROUP BY 1",
    "stats_chrom_freq": f"SELECT chrom1, chrom2, count(*) AS n FROM {_CLASSES} WHERE counted GROUP BY 1, 2",
    "stats_dist_freq": f"""SELECT bin, direction, count(*) AS n FROM (SELECT (SELECT max(CAST(e AS BIGINT)) FROM {_EDGES} WHERE e <= d) AS bin,
 CASE WHEN strand1 || strand2 IN ('+-', '-+', '--') THEN strand1 || strand2 ELSE '++' END AS direction FROM {_CLASSES} WHERE cis) GROUP BY 1, 2""",
    "stats_summary": f"WITH c AS ({_COUNTERS}) SELECT 'frac_cis' AS name, cis / total_nodups AS value FROM c" + "".join(f" UNION ALL SELECT 'frac_cis_{k}kb+', cis_{k}kb / total_nodups FROM c" for k in stats.CIS_KB) + " UNION ALL SELECT 'frac_dups', 0.0 FROM c",
    "stats_convergence": f"""WITH f AS (SELECT bin, direction, count(*) AS n FROM (SELECT (SELECT max(CAST(e AS BIGINT)) FROM {_EDGES} WHERE e <= d) AS bin,
 CASE WHEN strand1 || strand2 IN ('+-', '-+', '--') THEN strand1 || strand2 ELSE '++' END AS direction FROM {_CLASSES} WHERE cis) GROUP BY 1, 2),
e AS (SELECT e AS b, row_number() OVER (ORDER BY e) - 1 AS i FROM {_EDGES}), d AS (SELECT * FROM (VALUES ('++', 0), ('--', 1), ('-+', 2), ('+-', 3)) t(direction, o)),
x AS (SELECT * FROM e, d),
k AS (SELECT x.i, x.direction, x.o, coalesce(f.n, 0) AS n FROM x LEFT JOIN f ON f.bin = x.b AND f.direction = x.direction), h AS (SELECT *, avg(n) OVER (PARTITION BY i) AS m FROM k),
l AS (SELECT direction, o, coalesce(max(i) FILTER (m > 0 AND abs(n - m) / m > 0.05), 0) AS final FROM h GROUP BY 1, 2), w AS (SELECT * FROM l ORDER BY final DESC, o LIMIT 1)
SELECT 'convergence_dist' AS name, CASE WHEN final = 0 THEN '0' ELSE CAST(coalesce((SELECT b FROM e WHERE i = final + 1), 9223372036854775807) AS VARCHAR) END AS value FROM w
UNION ALL SELECT 'strands_w_max_convergence_dist', CASE WHEN final = 0 THEN '??' ELSE direction END FROM w""",
    "stats_dups": _DUPS,
    "dedup_parents": f"""SELECT n.readID, CASE WHEN outcome = 'dup' THEN 'DD' ELSE pair_type END AS pair_type,
 CASE outcome WHEN 'dup' THEN 'r' || CAST(parent AS STRING) WHEN 'unmapped' THEN '' ELSE n.readID END AS parent_readID FROM ({_N}) n JOIN ({_MAX3}) o USING (readID)""",
    "sort_extra": f"SELECT readID, row_number() OVER (ORDER BY chrom1, chrom2, pos1, pos2, pair_type, CAST(mapq1 AS STRING), strand2, seq) AS sort_rank FROM ({_N})",
    "sort_no_type": f"SELECT readID, row_number() OVER (ORDER BY chrom1, chrom2, pos1, pos2, seq) AS sort_rank FROM ({_N})",
    "remove_columns": f"SELECT readID, chrom1, pos1, chrom2, pos2, strand2, pair_type, mapq2 FROM ({_W})",
    "bin_counters": f"""WITH r AS (SELECT *, {_MAPPED} AND pair_type IN ('UU', 'UR') AND mapq1 >= 5 AND mapq2 >= 5 AS passed, chrom1 IN ({', '.join(f"'{c}'" for c in CHROMS[:9])}) AND chrom2 IN ({', '.join(f"'{c}'" for c in CHROMS[:9])}) AS known FROM ({_W})),
a AS (SELECT *, passed AND known AND pos1 > 0 AND pos2 > 0 AS ok FROM r)
SELECT 'accepted' AS name, count(*) FILTER (ok) AS n FROM a UNION ALL SELECT 'rejected', count(*) FILTER (NOT ok AND NOT (passed AND NOT known)) FROM a
UNION ALL SELECT 'unknown_chrom', count(*) FILTER (passed AND NOT known) FROM a UNION ALL SELECT 'out_of_range', count(*) FILTER (ok AND (pos1 > 600000 OR pos2 > 600000)) FROM a""",
    "dedup_exact": _transitive_sql("a.f = b.f"),
    "dedup_max3": _MAX3,
    "dedup_stream": _MAX3,
    "dedup_max10k": _transitive_sql("abs(a.pos1 - b.pos1) <= 10000 AND abs(a.pos2 - b.pos2) <= 10000", source=_W),
    "dedup_sum8k": _transitive_sql("abs(a.pos1 - b.pos1) + abs(a.pos2 - b.pos2) <= 8000", source=_W),
    "dedup_sum5": _transitive_sql("abs(a.pos1 - b.pos1) + abs(a.pos2 - b.pos2) <= 5"),
    "dedup_extra_cols": _transitive_sql("abs(a.pos1 - b.pos1) <= 3 AND abs(a.pos2 - b.pos2) <= 3", ", mapq1, mapq2"),
    "bin_coo_10k": f"SELECT bin1_id, bin2_id, count FROM ({_bins_sql(f'({_W})', '10000', 1_000_000)})",
    "bin_multi_res": _bins_sql(f"({_W})", "5000, 50000, 250000", 1_000_000),
    "bin_filtered": f"""SELECT bin1_id, bin2_id, count FROM ({_bins_sql(f"(SELECT * FROM ({_W}) WHERE pair_type = 'UU' AND mapq1 >= 20 AND mapq2 >= 20)", '100000', 1_000_000)})""",
    "bin_bg2": f"""SELECT 'chr' || CAST(bin1_id // 10 + 1 AS STRING) AS chrom1, bin1_id % 10 * 100000 AS start1, least((bin1_id % 10 + 1) * 100000, 950000) AS end1,
 'chr' || CAST(bin2_id // 10 + 1 AS STRING) AS chrom2, bin2_id % 10 * 100000 AS start2, least((bin2_id % 10 + 1) * 100000, 950000) AS end2, count FROM ({_bins_sql(f'({_W})', '100000', 950_000)})""",
    "bin_table": "SELECT CAST(i AS BIGINT) AS bin_id, 'chr' || CAST(i // 10 + 1 AS STRING) AS chrom, CAST(i % 10 * 100000 AS BIGINT) AS start, CAST(least((i % 10 + 1) * 100000, 950000) AS BIGINT) AS \"end\" FROM range(120) t(i)",
    "process_fused": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY chrom1, chrom2, pos1, pos2, strand1, strand2 ORDER BY seq) AS k FROM {_flip_sql(_N, 12)} WHERE {_MAPPED})
SELECT bin1_id, bin2_id, count FROM ({_bins_sql('(SELECT * FROM f WHERE k = 1)', '100', 1_000_000)})""",
}
