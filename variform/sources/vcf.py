"""VCF text in and out; interval tables and transcripts as annotation sources."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from variform.functions.projection import Projection
from variform.functions.variant import let
from variform.sources import bgzf, columns
from variform.sources.header import Field, VariantHeader

I32_MIN = -2147483640


def _first_file(spark: SparkSession, path: str):
    """(file system, path, size) of a file, or of the first data file of a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    if status.isDirectory():
        status = min((f for f in fs.listStatus(p) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
    return fs, status.getPath(), status.getLen()


def _magic(spark: SparkSession, path: str, n: int = 18) -> bytes:
    fs, p, size = _first_file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.read() for _ in range(min(n, size)))
    finally:
        stream.close()


def read_header(spark: SparkSession, path: str) -> VariantHeader:
    """The header of a (plain, gzip or BGZF) VCF."""
    return VariantHeader.parse(read_header_text(spark, path))


def read_header_text(spark: SparkSession, path: str) -> str:
    """The header's lines as they are: the driver reads up to the #CHROM line, and no further."""
    zipped = _magic(spark, path, 2) == b"\x1f\x8b"
    fs, p, _ = _first_file(spark, path)
    java = spark._jvm.java
    stream = fs.open(p)
    reader = java.io.BufferedReader(java.io.InputStreamReader(java.util.zip.GZIPInputStream(stream) if zipped else stream, "UTF-8"))
    lines: list[str] = []
    try:
        while (line := reader.readLine()) is not None and line.startswith("#"):
            lines.append(line)
            if line.startswith("#CHROM"):
                break
    finally:
        reader.close()
    return "".join(line + "\n" for line in lines)


def read_lines(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(row_id, value) of a text's lines in file order. Compression is known by the first bytes: BGZF files are read in
    ranges of split_bytes by many tasks, a folder's in the order of their names; other gzip by one task a file."""
    magic = _magic(spark, path)
    if magic[:2] != b"\x1f\x8b":
        return spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "value")
    if bgzf.block_size(magic, 0) is None or not _arrow_opens(_first_file(spark, path)[1].toString()):
        return _gzip_lines(spark, path)
    # the files stay in the plan, so that writing on them is refused; their content is not read here
    ranges = F.greatest(F.ceil(F.col("length") / split_bytes), F.lit(1))
    files = spark.read.format("binaryFile").load(path).select("path", "length", ranges.alias("n"))
    n, size = files.agg(F.sum("n"), F.sum("length")).first()
    files = files.withColumn("first", F.sum("n").over(Window.orderBy("path")) - F.col("n"))
    cut = files.select("path", "length", "first", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    cut = cut.select("path", "length", (F.col("k") * split_bytes).alias("start"), (F.col("first") + F.col("k")).alias("range"))
    tasks = max(-(-size // split_bytes), min(n, 4 * spark.sparkContext.defaultParallelism))
    return cut.repartitionById(tasks, F.floor(F.col("range") * tasks / n).cast("int")).mapInArrow(_range_reader(split_bytes), "row_id long, value string")


def _arrow_place(uri: str):
    """(pyarrow file system, path in it) of a path as Hadoop spells it, which escapes nothing."""
    from pyarrow import fs as arrow_fs

    return (arrow_fs.LocalFileSystem(), uri[5:]) if uri.startswith("file:/") else arrow_fs.FileSystem.from_uri(uri)


def _arrow_opens(uri: str) -> bool:
    try:
        system, place = _arrow_place(uri)
        return system.get_file_info(place).is_file
    except (pa.ArrowInvalid, NotImplementedError, OSError):
        return False


def _range_reader(split_bytes: int):
    def texts(stream, start: int, size: int) -> Iterator[bytes]:
        magic = stream.read(18)
        if bgzf.block_size(magic, 0) is not None:
            return bgzf.pieces(stream, start, min(size, start + split_bytes), size)
        # another file among the folder's: its first range is all of it
        stream.seek(0)
        source = gzip.open(stream) if magic[:2] == b"\x1f\x8b" else stream
        return bgzf.whole_lines(iter(lambda: source.read(1 << 20), b"")) if not start else iter(())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, place = _arrow_place(r["path"])
                at = r["range"] << 33
                with system.open_input_file(place) as stream:
                    for text in texts(stream, r["start"], r["length"]):
                        values = _split_lines(text)
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), values], names=["row_id", "value"])
                        at += len(values)

    return run


def _split_lines(text: bytes) -> pa.Array:
    """The lines of a text, whose last line feed may lack."""
    data = np.frombuffer(text if text.endswith(b"\n") else text + b"\n", np.uint8)
    feeds = data == 10
    ends = np.flatnonzero(feeds)
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data[~feeds]))


def _gzip_lines(spark: SparkSession, path: str) -> DataFrame:
    named = path.rstrip("/").endswith((".gz", ".gzip")) or spark.read.format("binaryFile").load(path).select("path").where("NOT path LIKE '%.gz'").isEmpty()
    if named:
        return spark.read.text(path).withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "value")

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = gzip.decompress(content.as_py()).decode("utf-8").split("\n")
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    # a name that does not tell: the file is one row
    text = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, "value string")
    return text.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "value")


def _typed(text: Column, f: Field) -> Column:
    """Typed value of a field's text; '.' is null, an element '.' a null element; out-of-range integers are null."""
    def one(t: Column) -> Column:
        t = F.when(t != ".", t)
        if f.type == "Integer":
            return let(t.cast("long"), lambda n: F.when(n.between(I32_MIN, 2147483647), n).cast("int"))
        return t.cast("double").cast("float") if f.type == "Float" else t

    return let(text, lambda t: F.when((t != ".") & (t != ""), one(t) if f.scalar else F.transform(F.split(t, ","), one)))


def genotype(text: Column) -> Column:
    """struct<alleles, phased> of a spelled genotype; null for '.' alone of no ploidy."""
    def call(t: Column) -> Column:
        bare = F.when(t.startswith("|") | t.startswith("/"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)
        return F.when(t != "", let(F.struct(t.alias("t"), bare.alias("bare")), spelled))

    def spelled(x: Column) -> Column:
        alleles = F.transform(F.split(F.translate(x["bare"], "|", "/"), "/"), lambda a: F.when(a != ".", a).cast("int"))
        seps = F.filter(F.split(F.regexp_replace(x["bare"], r"[^/|]+", " "), " "), lambda s: s != "")
        first = lambda p: F.when(x["t"].startswith("|"), True).when(x["t"].startswith("/"), False).otherwise(F.coalesce(F.get(p, F.lit(0)), F.lit(True)))
        return F.struct(alleles.alias("alleles"), let(F.transform(seps, lambda s: s == "|"), lambda p: F.concat(F.array(first(p)), p)).alias("phased"))

    return let(text, call)


def _read_in_batches(text: Column, otherwise: Column, reader, fields: dict[str, Field], listed: bool) -> Column:
    """What the reader makes of plain spellings, else what the expression makes of them."""
    base = lambda k, f: "boolean" if f.type == "Flag" and not listed else f.spark() if k == "GT" else {"Integer": "int", "Float": "float"}.get(f.type, "string")
    kinds = ", ".join(f"`{k}`: {base(k, f) if f.scalar else f'array<{base(k, f)}>'}" for k, f in fields.items())
    kind = T._parse_datatype_string(f"array<struct<{kinds}>>" if listed else f"struct<{kinds}>")
    run = F.arrow_udf(columns.column(to_arrow_type(kind), reader), kind)
    return F.coalesce(run(text), otherwise)


def parse_records(lines: DataFrame, header: VariantHeader) -> DataFrame:
    """Typed rows of body lines (row_id, value). Malformed columns fail with the line's number.

    INFO and samples of plain spelling are read in Arrow batches. In the expressions whatever is read more than once is
    bound, since an expression in a lambda is evaluated at every mention."""
    cols = F.split("value", "\t")
    n_cols = 8 + (1 + len(header.samples) if header.samples else 0)
    bad = F.raise_error(F.concat(F.lit("malformed record "), F.col("row_id").cast("string")))
    # a condition on the rows may be evaluated before the one that leaves comments out, so comments must not fail
    comment = F.col("value").startswith("#") | F.col("value").isin("", "\r")
    rows = lines.withColumn("c", let(cols, lambda x: F.when(comment, None).when(F.size(x) >= n_cols, x).otherwise(bad.cast("array<string>"))))
    c = lambda i: F.get("c", F.lit(i))
    pos = let(F.when(c(1).rlike(r"^\d+$"), c(1).cast("long")), lambda p: F.when(p.between(1, 2147483647), p).when(F.col("c").isNotNull(), bad.cast("long")).cast("int"))
    listed = lambda t, sep: F.when(t == ".", F.array().cast("array<string>")).otherwise(F.split(t, sep))
    idx = F.lit(None).cast("int")
    for i, name in enumerate(header.contigs):
        idx = F.when(c(0) == name, i).otherwise(idx)
    out = [
        F.col("row_id"), idx.alias("contig_idx"), c(0).alias("chrom"), pos.alias("pos"), listed(c(2), ";").alias("ids"), c(3).alias("ref"), listed(c(4), ",").alias("alts"),
        F.when(c(5) != ".", c(5)).cast("double").cast("float").alias("qual"), listed(c(6), ";").alias("filters"),
    ]
    if header.infos:
        entries = F.map_from_entries(F.transform(F.array_distinct(F.filter(F.split(c(7), ";"), lambda e: e != ".")), lambda e: F.struct(F.substring_index(e, "=", 1).alias("k"), F.when(e.contains("="), F.substring(e, F.instr(e, "=") + 1, F.length(e))).otherwise("").alias("v"))))
        item = lambda m, k: F.try_element_at(m, F.lit(k))
        info = let(entries, lambda m: F.struct(*[(item(m, k).isNotNull() if f.type == "Flag" else _typed(item(m, k), f)).alias(k) for k, f in header.infos.items()]))
        out.append(_read_in_batches(c(7), info, columns.info_reader(header), header.infos, False).alias("info"))
    if header.samples and header.formats:
        # places of the header's keys in FORMAT, from 0; -1 where it lacks the key
        places = let(F.split(c(8), ":"), lambda keys: F.struct(*[(F.array_position(keys, k) - 1).cast("int").alias(k) for k in header.formats]))

        def sample(parts: Column, at: Column) -> Column:
            values = ((k, f, F.get(parts, at[k])) for k, f in header.formats.items())
            return F.struct(*[(genotype(value) if k == "GT" else _typed(value, f)).alias(k) for k, f, value in values])

        samples = let(places, lambda at: F.transform(F.slice("c", 10, len(header.samples)), lambda text: let(F.split(text, ":"), lambda parts: sample(parts, at))))
        out.append(_read_in_batches(F.col("value"), samples, columns.samples_reader(header), header.formats, True).alias("samples"))
    return rows.select(*out)


def read_vcf(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> tuple[DataFrame, VariantHeader]:
    """(rows, header) of a plain, gzip or BGZF VCF, or of a folder that ``write_vcf`` made; row_id follows the file's order."""
    header = read_header(spark, path)
    lines = read_lines(spark, path, split_bytes).where(~F.col("value").startswith("#") & ~F.col("value").isin("", "\r"))
    return parse_records(lines.withColumn("value", F.regexp_replace("value", "\r$", "")), header), header


#: Rows of a sorted part at least, and sampled rows a part.
PART_ROWS, PART_SAMPLE = 20_000, 20


def _by_ranges(df: DataFrame, order: list[str], made: Column) -> DataFrame:
    """df's order and what is made of its rows, in partitions of rising ranges of the order.

    Spark's own ranges run the whole plan twice, once for a sample. Here only the order is sampled, by the smallest hashes of
    it, which also tell how many rows there are."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = PART_SAMPLE * most
    found = df.select(*order, F.xxhash64(*order).alias("_h")).orderBy("_h").limit(wanted).collect()
    rows = len(found) if len(found) < wanted else len(found) / ((found[-1]["_h"] + (1 << 63)) / (1 << 64) or 1)
    n = max(1, min(most, int(rows // PART_ROWS)))
    keys = sorted((tuple(r[c] for c in order) for r in found), key=lambda k: [(v is not None, v) for v in k])
    bounds = list(dict.fromkeys(keys[i * len(keys) // n] for i in range(1, n)))
    rows_made = df.select(*order, made)
    if not bounds:
        return rows_made.coalesce(1)
    kinds = [df.schema[c].dataType.simpleString() for c in order]
    spelled = lambda k: ", ".join(f"'{c}', CAST({'NULL' if v is None else v} AS {t})" for c, v, t in zip(order, k, kinds, strict=True))
    table = F.expr(f"array({', '.join(f'named_struct({spelled(k)})' for k in bounds)})")
    # the number of bounds up to the row's order, by halving steps
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= F.struct(*order), at + step).otherwise(at))
    return rows_made.repartitionById(len(bounds) + 1, place)


def record_lines(df: DataFrame, header: VariantHeader, ordered: bool = False) -> DataFrame:
    """(value) body lines, sorted by contig, position and input order (ordered: they are)."""
    line = Projection("", header).line().alias("value")
    if ordered:
        return df.select(line)
    # lines are several times smaller than typed rows, so they are what is moved and sorted
    order = ["contig_idx", "pos", "row_id"]
    return _by_ranges(df, order, line).sortWithinPartitions(*order).select("value")


HEADER_MODES = ("full", "only", "none")


def output_lines(df: DataFrame, header: VariantHeader, header_mode: str = "full", ordered: bool = False) -> DataFrame:
    """(value): the header in the first partition, then the sorted body in the partitions behind it."""
    if header_mode not in HEADER_MODES:
        raise ValueError(f"unknown header mode {header_mode}")
    head = df.sparkSession.createDataFrame([("\n".join(header.lines()),)], "value string").coalesce(1)
    if header_mode == "only":
        return head
    body = record_lines(df, header, ordered)
    return body if header_mode == "none" else head.unionByName(body)


def refuse_own_input(df: DataFrame, path: str) -> None:
    own = lambda f: f.replace("file:///", "/").replace("file:/", "/").rstrip("/")
    if any(own(f) == own(path) or own(f).startswith(own(path) + "/") for f in df.inputFiles()):
        raise ValueError(f"{path} is read from, it cannot be written")


def write_vcf(df: DataFrame, header: VariantHeader, path: str, compress: bool | str = False, header_mode: str = "full", overwrite: bool = False, ordered: bool = False) -> None:
    """A folder of sorted parts whose concatenation in the order of their names is one valid VCF, in one commit.

    compress: False, 'gzip' (or True) or 'bgzf', which ends with the empty block. header_mode: 'full', 'only' or 'none'. A
    folder that exists is an error unless overwrite; one that the rows are read from always is. ordered: df is sorted."""
    refuse_own_input(df, path)
    lines = output_lines(df, header, header_mode, ordered)
    if compress != "bgzf":
        lines.write.mode("overwrite" if overwrite else "errorifexists").options(**({"compression": "gzip"} if compress else {})).text(path)
        return
    commit_blocks(lines, _texts, path, "vcf.gz", overwrite=overwrite)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        if b.num_rows:
            lines = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pc.binary_join(lines, "\n")[0].as_buffer().to_pybytes() + b"\n"


def commit_blocks(df: DataFrame, chunks, path: str, suffix: str, *, compress: bool = True, overwrite: bool = False) -> None:
    """A folder of one part a partition of df, the bytes that chunks (batches -> bytes) makes of it, as BGZF with a last
    empty block or as they are, in one commit: attempts write to a folder beside the target under names of their own,
    and only those of finished tasks are moved."""
    spark = df.sparkSession
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop_path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise ValueError(f"{path} exists")
    staged = hadoop_path(path.rstrip("/") + f"._staged-{uuid.uuid4().hex}")
    fs.mkdirs(staged)
    try:
        uri = fs.makeQualified(staged).toString()
        parts = df.mapInArrow(_part_writer(uri, chunks, compress), "part int, name string, size long").collect()
        done = hadoop_path(staged, "done")
        fs.mkdirs(done)
        for r in parts:
            fs.rename(hadoop_path(staged, r.name), hadoop_path(done, f"part-{r.part:05d}.{suffix}"))
        last = [(f"part-{max((r.part for r in parts), default=0) + 1:05d}.{suffix}", bgzf.EOF_BLOCK)] if compress else []
        for name, content in [*last, ("_SUCCESS", b"")]:
            out = fs.create(hadoop_path(done, name))
            out.write(bytearray(content))
            out.close()
        if overwrite:
            fs.delete(target, True)
        if not fs.rename(done, target):
            raise OSError(f"{path} could not be put in place")
    finally:
        fs.delete(staged, True)


def _part_writer(uri: str, chunks, compress: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs
        from pyspark import TaskContext

        system, folder = arrow_fs.FileSystem.from_uri(uri)
        context = TaskContext.get()
        name, size = f"{context.partitionId():05d}-{context.taskAttemptId()}", 0
        with system.open_output_stream(f"{folder}/{name}") as out:
            for piece in bgzf.blocks(chunks(batches)) if compress else chunks(batches):
                out.write(piece)
                size += len(piece)
        yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "name": [name], "size": [size]})

    return run


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """One file of the parts that ``write_vcf`` made, streamed through the driver in the order of their names."""
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-"))
    staged = jvm.org.apache.hadoop.fs.Path(path + f"._staged-{uuid.uuid4().hex}")
    out = fs.create(staged)
    for name in names:
        part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
    out.close()
    if not fs.rename(staged, target):
        raise OSError(f"{path} could not be put in place")


def read_intervals(spark: SparkSession, path: str, columns: list[str], bed: bool | None = None) -> DataFrame:
    """Annotation rows of a tab-separated file with the named columns ('-' skips one): serial, chrom, from, to and the rest.

    '.' is null; '#' and blank lines are skipped; BED starts (by suffix) count from zero; an empty interval fails."""
    bed = any(path.endswith(f".bed{s}") for s in ("", ".gz", ".bgz", ".bgzf")) if bed is None else bed
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).withColumn("serial", F.monotonically_increasing_id())
    c = F.split("value", "\t")
    names = {"CHROM": "chrom", "POS": "from", "FROM": "from", "BEG": "from", "TO": "to", "END": "to"}
    picked = {names.get(n, n): F.get(c, F.lit(i)) for i, n in enumerate(columns) if n != "-"}
    picked.setdefault("to", picked["from"])
    value = lambda k: F.when(picked[k] != ".", picked[k])
    start = picked["from"].cast("int") + (1 if bed else 0)
    end = picked["to"].cast("int")
    checked = F.when(end >= start, end).otherwise(F.raise_error(F.lit("empty interval")).cast("int"))
    rest = [value(k).alias(k) for k in picked if k not in ("chrom", "from", "to")]
    return lines.select("serial", picked["chrom"].alias("chrom"), start.alias("from"), checked.alias("to"), *rest)


# Biotypes whose transcripts count, the first in any case, the others as they are spelled.
BIOTYPES_ANY_CASE = {"mRNA", "Mt_rRNA", "Mt_tRNA", "3prime_overlapping_ncRNA", "3_prime_overlapping_ncRNA"}
BIOTYPES = {
    "protein_coding", "polymorphic_pseudogene", "IG_C", "IG_D", "IG_J", "IG_LV", "IG_V", "TR_C", "TR_D", "TR_J", "TR_V", "NMD", "nonsense_mediated_decay", "non_stop_decay", "lincRNA", "lncRNA", "miRNA", "misc_RNA", "rRNA",
    "snRNA", "snoRNA", "processed_transcript", "antisense", "macro_lncRNA", "ribozyme", "sRNA", "scRNA", "scaRNA", "sense_intronic", "sense_overlapping", "pseudogene", "processed_pseudogene", "artifact", "IG_pseudogene",
    "IG_C_pseudogene", "IG_J_pseudogene", "IG_V_pseudogene", "TR_V_pseudogene", "TR_J_pseudogene", "MT_tRNA_pseudogene", "misc_RNA_pseudogene", "miRNA_pseudogene", "retained_intron", "retrotransposed", "tRNA_pseudogene",
    "Trna_pseudogene", "transcribed_processed_pseudogene", "transcribed_unprocessed_pseudogene", "transcribed_unitary_pseudogene", "translated_unprocessed_pseudogene", "translated_processed_pseudogene", "known_ncRNA",
    "known_ncrna", "unitary_pseudogene", "unprocessed_pseudogene", "LRG_gene", "disrupted_domain", "vaultRNA", "bidirectional_promoter_lncRNA", "ambiguous_orf",
}


def _failing(message: str, row: Column | str, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(message + " in line "), F.col(row).cast("string") if isinstance(row, str) else row)).cast(kind)


def read_transcripts(spark: SparkSession, path: str, biotypes: set[str] | None = None) -> DataFrame:
    """(chrom, start, end, reverse) of a GFF3's transcripts of the listed biotypes (given, or the fixed ones, by biotype,
    gene_biotype or the type itself); reverse is null where the strand is unknown.

    A malformed line, a repeated gene or transcript, and a transcript without ID, Parent or gene on its sequence are errors."""
    c = F.split("value", "\t")
    lines = read_lines(spark, path).withColumn("value", F.regexp_replace("value", "\r$", "")).where("value != '' AND NOT value LIKE '#%'")
    col = lambda i: F.get("c", F.lit(i))
    # conditions may be evaluated before those that leave comments out, so comments must not fail either
    comment = F.col("value").startswith("#") | (F.col("value") == "")
    rows = lines.select("row_id", F.when(F.size(c) == 9, c).when(~comment, _failing("nine columns expected", "row_id", "array<string>")).alias("c"))
    number = lambda i: F.when(col(i).rlike(r"^\+?[0-9]{1,10}$"), col(i).cast("int")).when(F.col("c").isNotNull(), _failing("a bad position", "row_id", "int"))
    attributes = F.filter(F.split(col(8), ";"), lambda a: a != "")
    sound = F.forall(attributes, lambda a: a.rlike("^[^=]+=.+$"))
    # a repeated key fails here
    entries = F.map_from_entries(F.transform(attributes, lambda a: F.struct(F.substring_index(a, "=", 1).alias("k"), F.substring(a, F.instr(a, "=") + 1, F.length(a)).alias("v"))))
    rows = rows.select("row_id", "c", F.when(sound, entries).when(F.col("c").isNotNull(), _failing("a bad attribute", "row_id", "map<string,string>")).alias("a"))
    attr = lambda k: F.try_element_at("a", F.lit(k))
    strand = F.when(col(6) == "-", True).when(col(6) == "+", False).when(~col(6).isin(".", "?"), _failing("a bad strand", "row_id", "boolean"))
    rows = rows.select(
        "row_id", col(0).alias("chrom"), col(2).alias("type"), number(3).alias("start"), number(4).alias("end"), strand.alias("reverse"), attr("ID").alias("id"), attr("Parent").alias("parent"),
        F.coalesce(attr("biotype"), attr("gene_biotype"), F.lit("")).alias("biotype"),
    )
    interval = F.when((F.col("start") > 0) & (F.col("end") >= F.col("start")), F.col("start")).when(F.col("start").isNotNull(), _failing("an empty interval", "row_id", "int"))
    rows = rows.withColumn("start", interval)
    is_gene = (F.col("type") == "gene") | F.coalesce(F.col("id").startswith("gene:"), F.lit(False))
    plain = lambda x, prefix: F.regexp_replace(x, f"^{prefix}:", "")
    genes = rows.where(is_gene & F.col("id").isNotNull()).groupBy(plain("id", "gene").alias("gene")).agg(F.count("*").alias("n"), F.min("chrom").alias("on"), F.max("row_id").alias("at"))
    genes = genes.select("gene", F.when(F.col("n") == 1, F.col("on")).otherwise(_failing("a repeated gene", "at", "string")).alias("on"))
    listed = lambda x: x.isin(*biotypes) if biotypes is not None else x.isin(*BIOTYPES) | F.lower(x).isin(*[b.lower() for b in BIOTYPES_ANY_CASE])
    out = rows.where(~is_gene & ~F.col("type").isin("CDS", "exon", "three_prime_UTR", "five_prime_UTR") & (listed(F.col("biotype")) | listed(F.col("type"))))
    out = out.withColumns({
        "id": F.coalesce(plain("id", "transcript"), _failing("a transcript without ID", "row_id", "string")), "gene": F.coalesce(plain("parent", "gene"), _failing("a transcript without Parent", "row_id", "string")),
    })
    repeated = out.groupBy("id").agg(F.count("*").alias("n"), F.max("row_id").alias("at"))
    out = out.join(repeated, "id").join(genes, "gene", "left")
    chrom = F.when(F.col("n") > 1, _failing("a repeated transcript", "at", "string")).when(F.col("on").isNull(), _failing("a transcript without its gene", "row_id", "string"))
    chrom = chrom.when(F.col("on") != F.col("chrom"), _failing("a transcript on another sequence than its gene", "row_id", "string")).otherwise(F.col("chrom"))
    return out.select(chrom.alias("chrom"), "start", "end", "reverse")


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(chrom, chunk, seq): sequences in pieces of ``chunk`` bases. The file is read in lines; every line's place in its
    sequence is the sum of the lengths before it, summed over blocks of lines, so no row holds a sequence."""
    lines = read_lines(spark, path).select("row_id", F.regexp_replace("value", "\\s+$", "").alias("value")).where("value != '' AND NOT value LIKE ';%'")
    heads = lines.where("value LIKE '>%'").select(F.col("row_id").alias("head"), F.regexp_extract("value", r"^>(\S+)", 1).alias("chrom"))
    # one row a sequence
    heads = heads.withColumn("until", F.coalesce(F.lead("head").over(Window.orderBy("head")), F.lit((1 << 63) - 1)))
    bases = lines.where("NOT value LIKE '>%'").withColumn("_block", F.floor(F.col("row_id") / 65536))
    bases = bases.join(F.broadcast(heads), (F.col("row_id") > F.col("head")) & (F.col("row_id") < F.col("until")))
    sizes = bases.groupBy("head", "_block").agg(F.sum(F.length("value")).alias("_n"))
    before = sizes.withColumn("_base", F.sum("_n").over(Window.partitionBy("head").orderBy("_block")) - F.col("_n")).drop("_n")
    inside = F.sum(F.length("value")).over(Window.partitionBy("head", "_block").orderBy("row_id")) - F.length("value")
    placed = bases.withColumn("_in", inside).join(before, ["head", "_block"]).withColumn("_at", F.col("_base") + F.col("_in"))
    # a line gives a piece to every chunk that it reaches
    reach = F.sequence(F.floor(F.col("_at") / chunk), F.floor((F.col("_at") + F.length("value") - 1) / chunk))
    cut = placed.withColumn("chunk", F.explode(reach))
    first = F.greatest(F.col("chunk") * chunk - F.col("_at"), F.lit(0))
    piece = F.substring("value", (first + 1).cast("int"), ((F.col("chunk") + 1) * chunk - F.greatest("_at", F.col("chunk") * chunk)).cast("int"))
    whole = cut.groupBy("head", "chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), piece.alias("s")))).alias("p"))
    return whole.select("chrom", F.col("chunk").cast("int").alias("chunk"), F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))
