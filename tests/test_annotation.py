import gzip

from tessera.operators import annotation, quality
from tessera.sources import files

def exon(chrom, first, last, strand, *attributes, feature="exon"):
    return "\t".join([chrom, "made", feature, str(first), str(last), "0", strand, ".", " ".join(f'{k} "{v}";' for k, v in attributes)])


GTF = [
    "# made by hand",
    exon("chrA", 7001, 7040, "-", ("transcript_id", "ta.2"), ("gene_id", "ga"), ("gene_name", "Alpha")),
    exon("chrA", 6000, 6500, "-", ("gene_id", "ga"), ("gene_name", "Alpha"), ("transcript_id", "ta.2")),
    exon("chrA", 6000, 7040, "-", ("transcript_id", "ta.2"), feature="CDS"),
    exon("chrB", 12, 12, "+", ("transcript_id", "tb"), ("gene_name", "Beta")),  # a single base
    exon("chrB", 30, 80, "+", ("transcript_id", "tc"), ("ref_gene_id", "not this"), ("gene_id", "gc")),  # no gene name
    exon("chrB", 40, 45, "+", ("transcript_id", "tc"), ("gene_id", "gc")),  # inside the exon before
    exon("chrC", 1, 9, "-", ("transcript_id", "td")),  # neither name nor id of a gene
    exon("chrC", "one", 9, "-", ("transcript_id", "te")),
    exon("chrC", 1, 9, "-", ("gene_name", "Zeta")),
    "chrC\tmade\texon\t1\t9\t0\t-\t.",
]


def call(chrom, first, last, mark, name, kind, number):
    return f" {number * 37}  12.5 1.0  0.0 {chrom} {first} {last} (99) {mark} {name} {kind} 3 45 (6) {number}"


RMSK = [
    "   SW  perc perc", "", "score div. del.",
    call("chrQ", 150, 260, "+", "n1", "DNA/hAT", 1),  # reaches into the first window
    call("chrQ", 900, 1000, "+", "n2", "DNA/hAT", 2),  # ends where the second window begins
    call("chrQ", 500, 501, "C", "n3", "Satellite", 3),  # the first window's last base and one beyond
    call("chrQ", 450, 1200, "+", "n4", "LTR/Gypsy", 4),  # in both
]


def lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "line string")


def test_transcripts(spark):
    rows = lines(spark, GTF)
    tx = {r.name: r for r in annotation.transcripts(annotation.exons(rows)).collect()}
    assert set(tx) == {"ta.2", "tb", "tc", "td"}
    assert (tx["ta.2"].exonStarts, tx["ta.2"].exonEnds, tx["ta.2"].txStart, tx["ta.2"].txEnd) == ([5999, 7000], [6500, 7040], 5999, 7040)
    assert (tx["ta.2"].name2, tx["ta.2"].strand) == ("Alpha", "-")
    assert (tx["tb"].exonStarts, tx["tb"].exonEnds, tx["tb"].name2) == ([11], [12], "Beta")
    assert (tx["tc"].name2, tx["tc"].txEnd, tx["td"].name2) == ("gc", 80, "td")
    assert sorted(r.fault for r in annotation.exon_rejects(rows).collect()) == ["coordinates", "transcript_id"]


def test_one_id_on_two_chromosomes_is_two_transcripts(spark):
    rows = lines(spark, [exon(c, 70, 90, "+", ("transcript_id", "same")) for c in ("chrM", "chrN")])
    assert annotation.transcripts(annotation.exons(rows)).count() == 2
    assert [tuple(r) for r in annotation.split_transcripts(annotation.exons(rows)).collect()] == [("same", 2)]


def windows(spark):
    return spark.createDataFrame([("one", "chrQ", 200, 500), ("two", "chrQ", 1000, 1100)], "uid string, chrom string, w0 long, w1 long")


def test_repeats(spark):
    rows = annotation.repeats(lines(spark, RMSK))
    found = {(r.uid, r.rep_name): (r.start0, r.end0, r.strand, r.overlap_bp) for r in annotation.repeats_in_windows(rows, windows(spark)).collect()}
    assert found == {("one", "n1"): (149, 260, "+", 60), ("one", "n3"): (499, 501, "-", 1), ("one", "n4"): (449, 1200, "+", 51), ("two", "n4"): (449, 1200, "+", 100)}


def test_genes_are_unions_of_their_exons(spark):
    made = [("i1", "G", "chrQ", 210, 480, "+", [210, 300, 470], [250, 320, 480]), ("i2", "G", "chrQ", 100, 400, "+", [100, 240, 320], [190, 260, 400]), ("i3", "H", "chrQ", 0, 900, "-", [0, 800], [50, 900])]
    tx = spark.createDataFrame(made, "name string, name2 string, chrom string, txStart long, txEnd long, strand string, exonStarts array<long>, exonEnds array<long>")
    got = {(r.uid, r.gene): r for r in annotation.gene_models(annotation.transcripts_in_windows(tx, windows(spark))).collect()}
    assert set(got) == {("one", "G"), ("one", "H")}
    g, h = got["one", "G"], got["one", "H"]
    assert [(x.start0, x.end0) for x in g.exons] == [(210, 260), (300, 400), (470, 480)] and (g.n_isoforms, g.start0, g.end0, g.n_exons, g.intron_only) == (2, 100, 480, 3, False)
    assert (h.exons, h.n_exons, h.intron_only, h.strand) == ([], 0, True, "-")


def test_repeat_stats(spark):
    more = [RMSK[3] + " *", RMSK[3].replace("chrQ", "chrZ"), RMSK[6].replace("LTR/Gypsy", "Unknown")]
    stats = annotation.ingest_stats(lines(spark, RMSK + more), windows(spark)).first().asDict()
    assert stats == {"data_lines": 6, "malformed": 1, "unplaced_chroms": 1, "unplaced_lines": 1, "repeats_in_window": 4, "locus_repeat_pairs": 6}
    assert annotation.malformed_repeats(lines(spark, RMSK + more)).count() == 1


def test_text_files_and_tiles(spark, tmp_path):
    with gzip.open(tmp_path / "a.gtf.gz", "wt") as f:
        f.write("\n".join(GTF))
    read = files.read_lines(spark, str(tmp_path / "a.gtf.gz"), partitions=3)
    assert annotation.transcripts(annotation.exons(read)).count() == 4
    assert {r.source for r in read.collect()} == {"a.gtf.gz"}
    (tmp_path / "tiles").mkdir()
    (tmp_path / "tiles/1.json").write_text('[{"name":"u","chrom":"k","txStart":20,"txEnd":95,"exonStarts":"20,61,","exonEnds":"33,95,","other":7}]')
    (tmp_path / "tiles/2.json").write_text('{"k":[{"name":"u","chrom":"k","txStart":20,"txEnd":95,"exonStarts":"20,61,","exonEnds":"33,95,"}],"l":[{"name":"v","chrom":"l"}]}')
    tiles = files.read_tiles(spark, str(tmp_path / "tiles"))
    assert tiles.count() == 3
    once = {r.name: r for r in annotation.first_transcripts(tiles).collect()}
    assert (once["u"].exonStarts, once["u"].exonEnds, once["v"].txStart, once["v"].exonStarts) == ([20, 61], [33, 95], None, [])
    assert annotation.with_exons(tiles).count() == 2


def test_uneven_exons_are_found(spark):
    schema = "name string, exonStarts array<long>, exonEnds array<long>"
    df = spark.createDataFrame([("a", [1], [2]), ("b", [1, 2], [3]), ("c", [], []), ("d", None, [1])], schema)
    assert sorted(r.name for r in quality.uneven_exons(df).collect()) == ["b", "c", "d"]


def test_distinct_transcripts_are_placed_as_others_and_modelled_in_as_many_tasks_as_asked(spark):
    rows = [(f"T{i}", f"G{i % 3}", "c", s := 37 * i, s + 90, "+-"[i % 2], [s, s + 60], [s + 20, s + 90]) for i in range(60)]
    tx = spark.createDataFrame(rows, "name string, name2 string, chrom string, txStart long, txEnd long, strand string, exonStarts array<long>, exonEnds array<long>")
    wins = spark.createDataFrame([(f"u{j}", "c", 200 * j, 200 * j + 300) for j in range(9)], "uid string, chrom string, w0 long, w1 long")
    placed = annotation.transcripts_in_windows(tx, wins, distinct=True)
    assert sorted(map(repr, placed.collect())) == sorted(map(repr, annotation.transcripts_in_windows(tx, wins).collect()))
    few, many = annotation.gene_models(placed), annotation.gene_models(placed, 7)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect()))
    plan = annotation.gene_models(placed.localCheckpoint(), 7)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x]
    assert dealt and all("hashpartitioning(uid" in x and ", 7)" in x for x in dealt)


def test_bounds_are_those_of_the_transcripts_without_their_exons(spark):
    from tessera.operators import intervals

    exons = annotation.exons(spark.createDataFrame([(x,) for x in GTF], "line string"))
    bounds = annotation.transcript_bounds(exons)
    whole = annotation.transcripts(exons).select(*bounds.columns)
    assert sorted(map(repr, bounds.collect())) == sorted(map(repr, whole.collect())) != []
    wins = spark.createDataFrame([("u", "chrA", 5000, 6001), ("v", "chrB", 90, 99)], "uid string, chrom string, w0 long, w1 long")
    met = intervals.covered(bounds.withColumnRenamed("name", "tx"), wins, ("name2",), start="txStart", end="txEnd", right_inclusive=True)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in met.collect()] == [("u", "Alpha")]
    assert "collect_list" not in plan and "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
