"""VCF headers: typed, ordered, immutable definitions; edited on the driver, never distributed as rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]


@dataclass(frozen=True)
class Field:
    """An INFO or FORMAT definition."""

    id: str
    number: str
    type: str
    description: str = ""

    @property
    def scalar(self) -> bool:
        return self.number == "1" or self.type == "Flag" or self.id == "GT"

    def spark(self) -> str:
        """DDL type of its values."""
        if self.id == "GT":
            return "struct<alleles:array<int>,phased:array<boolean>>"
        base = {"Integer": "int", "Float": "float", "Flag": "boolean"}.get(self.type, "string")
        return base if self.scalar else f"array<{base}>"


class HeaderError(ValueError):
    """A header that is not well formed, or an edit it does not allow."""


def parse_map(text: str) -> dict[str, str]:
    """Fields of <a=b,c="d,e">; quotes are dropped and their escapes resolved."""
    if not (text.startswith("<") and text.endswith(">")):
        raise HeaderError(f"structured value expected: {text}")
    out: dict[str, str] = {}
    for m in re.finditer(r'\s*([^=,<>]+)=("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)', text[1:-1]):
        value = m[2]
        out[m[1].strip()] = re.sub(r"\\(.)", r"\1", value[1:-1]) if value[:1] == '"' else value
    return out


def _render_map(kind: str, fields: dict[str, str]) -> str:
    quoted = {"Description", "Source", "Version"}
    parts = []
    for k, v in fields.items():
        escaped = v.replace("\\", "\\\\").replace('"', '\\"')
        parts.append(f'{k}="{escaped}"' if k in quoted else f"{k}={v}")
    return f"##{kind}=<{','.join(parts)}>"


@dataclass(frozen=True)
class VariantHeader:
    """An ordered header. contigs: name -> extra fields; filters: name -> description; other: lines kept as they are."""

    version: str = "VCFv4.3"
    infos: dict[str, Field] = field(default_factory=dict)
    formats: dict[str, Field] = field(default_factory=dict)
    filters: dict[str, str] = field(default_factory=lambda: {"PASS": "All filters passed"})
    contigs: dict[str, dict[str, str]] = field(default_factory=dict)
    samples: tuple[str, ...] = ()
    other: tuple[str, ...] = ()

    @staticmethod
    def parse(text: str) -> VariantHeader:
        lines = [line.rstrip("\r") for line in text.splitlines() if line.rstrip("\r")]
        if not lines or not lines[0].startswith("##fileformat="):
            raise HeaderError("the first line must be ##fileformat=")
        h = {"infos": {}, "formats": {}, "filters": {"PASS": "All filters passed"}, "contigs": {}, "other": []}
        samples: tuple[str, ...] = ()
        for line in lines[1:]:
            if line.startswith("#CHROM"):
                cols = line[1:].split("\t")
                if cols[:8] != FIXED:
                    raise HeaderError("#CHROM line must start with the eight fixed columns")
                samples = tuple(cols[9:])
                if len(set(samples)) != len(samples):
                    raise HeaderError("duplicate sample name")
                break
            m = re.match(r"##(INFO|FORMAT|FILTER|contig)=(<.*>)$", line)
            if not m:
                h["other"].append(line)
                continue
            fields = parse_map(m[2])
            fields.pop("IDX", None)
            key = fields.get("ID")
            if not key:
                raise HeaderError(f"definition without ID: {line}")
            if m[1] in ("INFO", "FORMAT"):
                h["infos" if m[1] == "INFO" else "formats"][key] = Field(key, fields.get("Number", "."), fields.get("Type", "String"), fields.get("Description", ""))
            elif m[1] == "FILTER":
                h["filters"][key] = fields.get("Description", "")
            else:
                h["contigs"][key] = {k: v for k, v in fields.items() if k != "ID"}
        else:
            raise HeaderError("#CHROM line is missing")
        return VariantHeader(lines[0].split("=", 1)[1], h["infos"], h["formats"], h["filters"], h["contigs"], samples, tuple(h["other"]))

    def lines(self) -> list[str]:
        """Canonical text: file format, PASS first, then definitions, then columns."""
        out = [f"##fileformat={self.version}"]
        out += [_render_map("FILTER", {"ID": k, "Description": v}) for k, v in sorted(self.filters.items(), key=lambda kv: kv[0] != "PASS")]
        for kind, fields in (("INFO", self.infos), ("FORMAT", self.formats)):
            out += [_render_map(kind, {"ID": f.id, "Number": f.number, "Type": f.type, "Description": f.description}) for f in fields.values()]
        out += [_render_map("contig", {"ID": k} | v) for k, v in self.contigs.items()]
        out += list(self.other)
        columns = FIXED + (["FORMAT", *self.samples] if self.samples else [])
        return [*out, "#" + "\t".join(columns)]

    def info_type(self) -> str:
        return "struct<" + ",".join(f"`{k}`:{f.spark()}" for k, f in self.infos.items()) + ">"

    def sample_type(self) -> str:
        return "struct<" + ",".join(f"`{k}`:{f.spark()}" for k, f in self.formats.items()) + ">"

    def schema(self) -> str:
        """DDL of the rows this header describes."""
        fields = ["row_id bigint", "contig_idx int", "chrom string", "pos int", "ids array<string>", "ref string", "alts array<string>", "qual float", "filters array<string>"]
        if self.infos:
            fields.append(f"info {self.info_type()}")
        if self.formats:
            fields.append(f"samples array<{self.sample_type()}>")
        return ", ".join(fields)

    def with_(self, **changes) -> VariantHeader:
        return replace(self, **changes)

    def with_filter(self, name: str, description: str) -> VariantHeader:
        return self if name in self.filters else self.with_(filters=self.filters | {name: description})

    def append_line(self, line: str) -> VariantHeader:
        """Add exactly one INFO, FORMAT, FILTER or contig definition."""
        m = re.match(r"##(INFO|FORMAT|FILTER|contig)=<.*>$", line)
        if not m:
            raise HeaderError(f"one INFO, FORMAT, FILTER or contig line expected: {line}")
        one = VariantHeader.parse(f"##fileformat={self.version}\n{line}\n#" + "\t".join(FIXED))
        kind = {"INFO": "infos", "FORMAT": "formats", "FILTER": "filters", "contig": "contigs"}[m[1]]
        new = {k: v for k, v in getattr(one, kind).items() if not (kind == "filters" and k == "PASS")}
        clash = next((k for k in new if k in getattr(self, kind)), None)
        if clash:
            raise HeaderError(f"{m[1]}/{clash} is already defined")
        return self.with_(**{kind: getattr(self, kind) | new})

    def replace_from(self, other: VariantHeader) -> VariantHeader:
        """Full replacement; the number of samples must stay."""
        if len(other.samples) != len(self.samples):
            raise HeaderError(f"{len(other.samples)} samples cannot replace {len(self.samples)}")
        return other

    def sync_contigs(self, fai: list[tuple[str, int]]) -> VariantHeader:
        """Contigs of a FASTA index: listed ones keep their other fields, unlisted ones go, new ones are appended."""
        names = [n for n, _ in fai]
        if not names or len(set(names)) != len(names):
            raise HeaderError("contig names must be present and unique")
        length = {n: str(size) for n, size in fai}
        kept = {k: v | {"length": length[k]} for k, v in self.contigs.items() if k in length}
        return self.with_(contigs=kept | {n: {"length": length[n]} for n in names if n not in kept})

    def rename_samples(self, names: list[str]) -> VariantHeader:
        """All names in order, or 'old new' pairs."""
        if all(len(n.split()) == 2 for n in names) and names:
            pairs = dict(n.split() for n in names)
            missing = [k for k in pairs if k not in self.samples]
            if missing:
                raise HeaderError(f"unknown sample {missing[0]}")
            new = tuple(pairs.get(s, s) for s in self.samples)
        else:
            if len(names) != len(self.samples):
                raise HeaderError(f"{len(names)} names for {len(self.samples)} samples")
            new = tuple(names)
        if len(set(new)) != len(new):
            raise HeaderError("duplicate sample name")
        return self.with_(samples=new)


def parse_fai(text: str) -> list[tuple[str, int]]:
    """(name, length) of a FASTA index."""
    out = []
    for line in text.splitlines():
        cols = line.split("\t")
        if len(cols) < 2 or not cols[1].isdigit():
            raise HeaderError(f"name and length expected: {line!r}")
        out.append((cols[0], int(cols[1])))
    if not out or len({n for n, _ in out}) != len(out):
        raise HeaderError("contig names must be present and unique")
    return out
