"""The operators on files: every command reads variants, writes variants or text, and returns a summary of the run.

``python -m variform COMMAND --help``. Output is a folder of parts in one commit, or with --single one file of them; -O v, z, b
or u is plain VCF, BGZF VCF, BCF or raw BCF. The summary is printed as one JSON line on standard error.

Records that are written are counted behind the sort, where each passes once (the sampling of a sort by range would count
twice what lies before it); records that are read are counted by their lines."""

from __future__ import annotations

import argparse
import json
import re
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from variform.functions.projection import Projection, query
from variform.operators import annotate, filtering, norm, regions, setgt, validate_text, view
from variform.sources import bcf, vcf
from variform.sources.header import VariantHeader, parse_fai

Rows = tuple[DataFrame, VariantHeader]


def read(spark: SparkSession, path: str) -> Rows:
    """Variants of a VCF or BCF, by content."""
    magic = vcf._magic(spark, path)
    if magic[:3] == b"BCF" or (magic[:2] == b"\x1f\x8b" and _zipped_bcf(spark, path)):
        return bcf.read_bcf(spark, path)
    return vcf.read_vcf(spark, path)


def _zipped_bcf(spark: SparkSession, path: str) -> bool:
    fs, p, _ = vcf._first_file(spark, path)
    stream = spark._jvm.java.util.zip.GZIPInputStream(fs.open(p))
    try:
        return bytes(max(0, stream.read()) for _ in range(3)) == b"BCF"
    finally:
        stream.close()


def write(df: DataFrame, header: VariantHeader, path: str, kind: str = "v", *, single: bool = False, overwrite: bool = False, header_mode: str = "full", counters: dict[str, Column] | None = None) -> dict:
    """Write variants and count them: {"written": n, and the sums of counters}."""
    spark = df.sparkSession
    seen = Observation("written")
    extra = {f"_count_{k}": c.cast("long") for k, c in (counters or {}).items()}
    carried = df.withColumns(extra)
    rows = carried.repartitionByRange("contig_idx", "pos", "row_id").sortWithinPartitions("contig_idx", "pos", "row_id")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c.removeprefix("_count_")) for c in extra]
    rows = rows.observe(seen, F.count(F.lit(1)).alias("written"), *sums).drop(*extra)
    target = f"{path.rstrip('/')}._parts" if single else path
    vcf.refuse_own_input(df, path)
    if kind in ("b", "u"):
        bcf.write_bcf(rows, header, target, compress=kind == "b", overwrite=overwrite, ordered=True)
    else:
        vcf.write_vcf(rows, header, target, compress="bgzf" if kind == "z" else False, header_mode=header_mode, overwrite=overwrite, ordered=True)
    if single:
        vcf.join_parts(spark, target, path)
        p = spark._jvm.org.apache.hadoop.fs.Path(target)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    # without a body nothing was observed, and asking would wait for ever
    return {"written": 0} if header_mode == "only" else dict(seen.get)


def _lines(path: str | None) -> list[str]:
    if not path:
        return []
    with open(path, encoding="utf-8") as f:
        return [line.rstrip("\r\n") for line in f if line.strip()]


def _places(listed: str | None, path: str | None, header: VariantHeader) -> list[tuple[str, int, int]] | None:
    if listed is None and path is None:
        return None
    if path:
        return regions.read_regions(_lines(path), bed=path.endswith((".bed", ".bed.gz")))
    # a comma before three digits, behind a position, belongs to a number
    parts: list[str] = []
    for piece in listed.split(","):
        if parts and re.search(r":[\d,-]*\d$", parts[-1]) and re.fullmatch(r"\d{3}(-\d*)?", piece):
            parts[-1] += "," + piece
        else:
            parts.append(piece)
    return [regions.parse_region(r, header.contigs) for r in parts]


def _selected_places(df: DataFrame, header: VariantHeader, a: argparse.Namespace) -> DataFrame:
    end = F.col("info.END") if "END" in header.infos else None
    if (places := _places(a.regions, a.regions_file, header)) is not None:
        df = regions.select_regions(df, places, a.regions_overlap, info_end=end)
    negate = bool(a.targets and a.targets.startswith("^"))
    if (places := _places((a.targets or "").removeprefix("^") or None, a.targets_file, header)) is not None:
        df = regions.select_regions(df, places, a.targets_overlap, negate=negate, info_end=end)
    return df


def _digest(df: DataFrame, names: list[str]) -> Column:
    return F.xxhash64(F.to_json(F.struct(*[c for c in names if c in df.columns])))


def _names(listed: str | None, path: str | None) -> list[str] | None:
    names = listed.removeprefix("^").split(",") if listed else _lines(path) if path else None
    return names or None


# ---------------------------------------------------------------- commands

def view_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    n = df.count()
    df = _selected_places(df, header, a)
    if (names := _names(a.samples, a.samples_file)) is not None or a.drop_genotypes:
        exclude = bool(a.samples and a.samples.startswith("^"))
        df, header = view.select_samples(df, header, names if names is not None else list(header.samples), exclude=exclude, drop_genotypes=a.drop_genotypes, **({"update": False} if a.no_update else {}))
    df = view.select_records(df, filters=a.apply_filters.split(",") if a.apply_filters else None, known=True if a.known else False if a.novel else None, types=a.types, exclude_types=a.exclude_types, min_alleles=a.min_alleles, max_alleles=a.max_alleles)
    mode = "only" if a.header_only else "none" if a.no_header else "full"
    return {"read": n} | write(df, header, a.output, a.output_type, single=a.single, overwrite=a.force, header_mode=mode)


def filter_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    n = df.count()
    df = _selected_places(df, header, a)
    mask = _places(a.mask, a.mask_file, header)
    df, header = filtering.filter_variants(
        df, header, include=a.include, exclude=a.exclude, soft=a.soft_filter, mode=a.mode, set_genotypes=a.set_gts, mask=mask, mask_overlap=a.mask_overlap,
    )
    if a.snp_gap or a.indel_gap:
        distance, _, types = (a.snp_gap or "").partition(":")
        snp = (int(distance), types or "indel") if distance else None
        df, header = filtering.gap_filter(df, header, snp=snp, indel=a.indel_gap, soft=a.soft_filter is not None, require_order=True)
    passed = F.coalesce(F.array_contains("filters", "PASS") | (F.size("filters") == 0), F.lit(True))
    return {"read": n} | write(df, header, a.output, a.output_type, single=a.single, overwrite=a.force, counters={"passed": passed})


def norm_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    n = df.count()
    df = _selected_places(df, header, a)
    fasta = vcf.read_fasta(spark, a.fasta_ref) if a.fasta_ref else None
    transcripts = vcf.read_transcripts(spark, a.gff_annot) if a.gff_annot else None

    def steps(rows: DataFrame) -> DataFrame:
        nonlocal header
        if fasta is not None:
            rows = norm.check_reference(rows, fasta, a.check_ref) if a.check_ref in ("e", "x", "s") else rows
        if a.atomize:
            rows, header = norm.atomize(rows, header, star=a.atom_overlaps == "*", old_rec_tag=a.old_rec_tag)
        if a.split_multiallelic:
            rows = norm.split_multiallelic(rows, header, overlaps_missing=a.multi_overlaps == ".", keep_sum=a.keep_sum == "AD")
        if fasta is not None:
            rows = norm.normalize(rows, fasta, transcripts=transcripts)
        if a.join_multiallelic:
            rows = norm.join_multiallelic(rows.drop("part"), header, a.join_multiallelic, a.strict_filter)
        return norm.remove_duplicates(rows, header, a.rm_dup) if a.rm_dup else rows

    df = norm.selected(df, header, steps, a.include, a.exclude) if a.include or a.exclude else steps(df)
    if "part" in df.columns:
        # records of one origin stand in the order of their parts
        df = df.withColumn("row_id", F.col("row_id") * 4096 + F.col("part")).drop("part")
    return {"read": n} | write(df, header, a.output, a.output_type, single=a.single, overwrite=a.force)


def annotate_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    n = df.count()
    df = _selected_places(df, header, a)
    for line in [*(a.header_line or []), *_lines(a.header_lines)]:
        header = header.append_line(line)
    site = filtering.condition(header, a.include, a.exclude).site if a.include or a.exclude else None
    if site is not None and not a.keep_sites:
        df, site = df.where(site), None
    names = df.columns
    df = df.withColumn("_before", _digest(df, names))
    keep = site
    if a.annotations:
        columns = a.columns or ",".join(_lines(a.columns_file))
        if a.annotations.endswith((".vcf", ".vcf.gz", ".bcf", ".vcf.bgz")):
            source, source_header = read(spark, a.annotations)
            df, header = annotate.annotate_variants(df, header, source, source_header, columns, logic=a.pair_logic, samples=_names(a.samples, a.samples_file), exclude=bool(a.samples and a.samples.startswith("^")), keep=keep)
        else:
            layout = [c.split(":=")[-1].lstrip(".+=-").split("/")[-1] if c not in ("-", "~ID", "~INFO/END") else c for c in columns.split(",")]
            source = vcf.read_intervals(spark, a.annotations, layout)
            share = tuple(float(x or 0) for x in a.min_overlap.split(":")) if a.min_overlap else None
            if a.mark_sites:
                matched = annotate.match_intervals(df, header, source, share)
                df, header = annotate.mark_sites(df, header, matched, a.mark_sites.lstrip("+-"), not a.mark_sites.startswith("-"))
            else:
                df, header = annotate.annotate_intervals(df, header, source, columns, min_overlap=share, keep=keep)
    if a.set_id:
        made = annotate.set_id(df, header, a.set_id)
        df = made if keep is None else made.withColumn("ids", F.when(keep, F.col("ids")).otherwise(F.col("ids")))
    if a.remove:
        df, header = annotate.remove(df, header, a.remove)
    pairs = lambda path: dict(line.split()[:2] for line in _lines(path))
    if a.rename_annots or a.rename_chrs:
        df, header = annotate.rename(df, header, pairs(a.rename_annots), pairs(a.rename_chrs))
    changed = F.col("_before") != _digest(df, names)
    return {"read": n} | write(df, header, a.output, a.output_type, single=a.single, overwrite=a.force, counters={"changed": changed})


def setgt_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    n = df.count()
    fraction = None
    target = a.target_gt
    if target.startswith("r:"):
        target, fraction = "a", float(target[2:])
    out = setgt.set_genotypes(df.withColumn("_before", F.col("samples")), header, target, a.new_gt, include=a.include, exclude=a.exclude, fraction=fraction, seed=a.seed or 0)
    both = F.arrays_zip("_before", "samples")
    differ = F.size(F.filter(both, lambda p: ~p["_before"]["GT"].eqNullSafe(p["samples"]["GT"])))
    per = lambda p: F.size(F.filter(F.zip_with(p["_before"]["GT"]["alleles"], p["samples"]["GT"]["alleles"], lambda x, y: ~x.eqNullSafe(y)), lambda t: t))
    alleles = F.aggregate(F.transform(both, lambda p: F.greatest(per(p), F.lit(0))), F.lit(0), lambda acc, x: acc + x)
    return {"read": n} | write(out, header, a.output, a.output_type, single=a.single, overwrite=a.force, counters={"genotypes": differ, "alleles": alleles})


def reheader_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    if a.header:
        with open(a.header, encoding="utf-8") as f:
            new = VariantHeader.parse(f.read())
        known = lambda h: {k: (f.number, f.type) for k, f in (h.infos | h.formats).items()}
        if known(new) != known(header):
            # fields of another type are read again by the new header
            lines = vcf.read_lines(spark, a.input).where(~F.col("value").startswith("#") & (F.col("value") != ""))
            df = vcf.parse_records(lines, header.replace_from(new))
        header = header.replace_from(new)
    if a.fai:
        with open(a.fai, encoding="utf-8") as f:
            header = header.sync_contigs(parse_fai(f.read()))
    if a.samples_file:
        header = header.rename_samples(_lines(a.samples_file))
    return write(df, header, a.output, a.output_type, single=a.single, overwrite=a.force)


def query_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    names = _names(a.samples, a.samples_file)
    if a.list_samples:
        print("\n".join(header.samples))
        return {"records": 0}
    if a.include or a.exclude:
        df = filtering.filter_variants(df, header, include=a.include, exclude=a.exclude)[0]
    df = _selected_places(df, header, a)
    out = query(df, header, a.format, names)
    if a.print_header:
        top = Projection(a.format, header, names or None).header_row().rstrip("\n")
        out = spark.createDataFrame([(-1, top)], "row_id long, value string").unionByName(out)
    seen = Observation("records")
    rows = out.repartitionByRange("row_id").sortWithinPartitions("row_id").observe(seen, F.count(F.when(F.col("row_id") >= 0, 1)).alias("records"))
    rows.select("value").write.mode("overwrite" if a.force else "errorifexists").text(a.output)
    return dict(seen.get)


def head_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    rows = view.head_lines(df, header, a.records, a.header_lines, a.from_chrom).orderBy("line").collect()  # as many as were asked for
    print("\n".join(r.value for r in rows))
    n = sum(not r.value.startswith("#") for r in rows)
    return {"header_lines": len(rows) - n, "records": n}


def index_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    df, header = read(spark, a.input)
    stats = view.contig_stats(df, header, all_contigs=a.all).orderBy("contig_idx").collect()  # one row a contig
    for r in stats:
        print("\t".join(str(x) if x is not None else "." for x in (r.chrom, r.length, r.records)))
    return {"records": sum(r.records for r in stats)}


def validate_command(spark: SparkSession, a: argparse.Namespace) -> dict:
    _, report = validate_text.validate_vcf(spark, a.input, a.max_diagnostics, a.require_evidence)
    return report.first().asDict(recursive=True)


# ---------------------------------------------------------------- arguments

def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="variform", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run: Callable, *, output: bool = True, places: bool = False, expression: bool = False, samples: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("input")
        if output:
            p.add_argument("-o", "--output", required=True)
            p.add_argument("-O", "--output-type", choices=list("vzbu"), default="v")
            p.add_argument("--single", action="store_true", help="one file instead of a folder of parts")
            p.add_argument("--force", action="store_true", help="replace an output that exists")
        if places:
            for short, long, mode in (("r", "regions", "record"), ("t", "targets", "pos")):
                p.add_argument(f"-{short}", f"--{long}")
                p.add_argument(f"-{short.upper()}", f"--{long}-file")
                p.add_argument(f"--{long}-overlap", choices=["pos", "record", "variant"], default=mode)
        if expression:
            group = p.add_mutually_exclusive_group()
            group.add_argument("-i", "--include")
            group.add_argument("-e", "--exclude")
        if samples:
            p.add_argument("-s", "--samples")
            p.add_argument("-S", "--samples-file")
        return p

    p = command("view", view_command, places=True, samples=True)
    for flag in ("--header-only", "--no-update", "--known", "--novel", "--drop-genotypes", "--no-header"):
        p.add_argument(*({"--known": ["-k"], "--novel": ["-n"], "--drop-genotypes": ["-G"], "--no-header": ["-H"], "--no-update": ["-I"]}.get(flag, [])), flag, action="store_true")
    p.add_argument("-f", "--apply-filters")
    p.add_argument("-v", "--types")
    p.add_argument("-V", "--exclude-types")
    p.add_argument("-m", "--min-alleles", type=int)
    p.add_argument("-M", "--max-alleles", type=int)
    p = command("filter", filter_command, places=True, expression=True)
    p.add_argument("-s", "--soft-filter")
    p.add_argument("-m", "--mode", default="", choices=["", "+", "x", "+x"])
    p.add_argument("-S", "--set-GTs", dest="set_gts", choices=[".", "0"])
    p.add_argument("-g", "--SnpGap", dest="snp_gap")
    p.add_argument("-G", "--IndelGap", dest="indel_gap", type=int)
    p.add_argument("--mask")
    p.add_argument("-M", "--mask-file")
    p.add_argument("--mask-overlap", choices=["pos", "record", "variant"], default="record")
    p = command("norm", norm_command, places=True, expression=True)
    p.add_argument("-f", "--fasta-ref")
    p.add_argument("-g", "--gff-annot")
    p.add_argument("-m", "--split-multiallelic", action="store_true")
    p.add_argument("--join-multiallelic", choices=["snps", "indels", "both", "any"])
    p.add_argument("--strict-filter", action="store_true")
    p.add_argument("--multi-overlaps", choices=["0", "."], default="0")
    p.add_argument("-a", "--atomize", action="store_true")
    p.add_argument("--atom-overlaps", choices=["*", "."], default="*")
    p.add_argument("--old-rec-tag")
    p.add_argument("--rm-dup", choices=["snps", "indels", "both", "all", "exact"])
    p.add_argument("--keep-sum", choices=["AD"])
    p.add_argument("--check-ref", choices=["e", "w", "x", "s"], default="e")
    p = command("annotate", annotate_command, places=True, expression=True, samples=True)
    p.add_argument("-a", "--annotations")
    p.add_argument("-c", "--columns")
    p.add_argument("-C", "--columns-file")
    p.add_argument("-H", "--header-line", action="append")
    p.add_argument("--header-lines")
    p.add_argument("-I", "--set-id")
    p.add_argument("-x", "--remove")
    p.add_argument("--rename-annots")
    p.add_argument("--rename-chrs")
    p.add_argument("-k", "--keep-sites", action="store_true")
    p.add_argument("-m", "--mark-sites")
    p.add_argument("--min-overlap")
    p.add_argument("--pair-logic", choices=annotate.PAIRINGS, default="some")
    p = command("setgt", setgt_command, expression=True)
    p.add_argument("-t", "--target-gt", required=True)
    p.add_argument("-n", "--new-gt", required=True)
    p.add_argument("-s", "--seed", type=int)
    p = command("reheader", reheader_command)
    p.add_argument("--header")
    p.add_argument("-f", "--fai")
    p.add_argument("-s", "--samples-file")
    p = command("query", query_command, places=True, expression=True, samples=True)
    p.add_argument("-f", "--format", default="")
    p.add_argument("--print-header", action="store_true")
    p.add_argument("-l", "--list-samples", action="store_true")
    p = command("head", head_command, output=False)
    p.add_argument("--header-lines", type=int)
    p.add_argument("-n", "--records", type=int, default=0)
    p.add_argument("--from-chrom", action="store_true")
    p = command("index", index_command, output=False)
    p.add_argument("--all", action="store_true")
    p = command("validate", validate_command, output=False)
    p.add_argument("--max-diagnostics", type=int, default=100)
    p.add_argument("--require-evidence", action="store_true")
    return parser


def run(spark: SparkSession, arguments: list[str]) -> dict:
    """Run a command and return its summary."""
    a = _parser().parse_args(arguments)
    return a.run(spark, a)


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    parsed = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"variform {parsed.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    summary = run(spark, arguments)
    print(json.dumps(summary, default=str), file=sys.stderr)
    return 1 if summary.get("errors") else 0
