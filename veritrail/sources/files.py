"""Folders of texts, office documents, annotations and word lists; the sinks beside them."""

from __future__ import annotations

import io
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

_TEXT_NODE = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_STEM = r"([^/]+?)(?:\.[^./]*)?$"


def _below(spark: SparkSession, folder: str, pattern: str, deep: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", deep).option("pathGlobFilter", pattern).load(folder)


def _found(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The files of a pattern in a folder; those below it only if the folder itself has none."""
    top = _level(spark, folder, pattern)
    return top if top is not None else _below(spark, folder, pattern, True)


def _level(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """The files of a pattern that lie in the folder itself, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder.rstrip("/"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isFile()] if fs.exists(path) else []
    suffix = pattern.lstrip("*")
    return _below(spark, folder, pattern, False) if any(n.endswith(suffix) for n in names) else None


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for content in frame["content"]:
            try:
                rows.append((content.decode("utf-8"), None))
            except UnicodeDecodeError as e:
                rows.append((None, f"UnicodeDecodeError: {e}"))
        yield pd.DataFrame({"path": frame["path"], "text": [r[0] for r in rows], "error": [r[1] for r in rows]})


_READ = "path string, text string, error string"


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text, error of all *.txt in and below a folder, once a path. A file that is no UTF-8 has its reason in error."""
    return _below(spark, folder, "*.txt", True).select("path", "content").mapInPandas(_decoded, _READ)


def docx_text(content: bytes) -> str:
    """The paragraphs of a word document, a blank line between them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join({"t": n.text or "", "tab": "\t", "br": "\n"}.get(n.tag.removeprefix(_TEXT_NODE), "") for n in p.iter()) for p in root.iter(f"{_TEXT_NODE}p"))
    return "\n\n".join(x for x in lines if x.strip()) + "\n"


def command_converter(*command: str, timeout: float = 120) -> Callable[[bytes], str]:
    """A converter that runs a program on the workers: the file's bytes go in, UTF-8 text comes out. For old word files,
    which have no reader here, e.g. command_converter("antiword", "-m", "UTF-8", "-")."""

    def convert(content: bytes) -> str:
        return subprocess.run(command, input=content, capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8")

    return convert


def _converted(doc: Callable[[bytes], str] | None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, errors = [], []
            for path, content in zip(frame["path"], frame["content"]):
                convert = doc if path.endswith(".doc") else docx_text
                try:
                    if convert is None:
                        raise ValueError("no converter for .doc")
                    texts.append(convert(content))
                    errors.append(None)
                except Exception as e:  # the file is at fault, whatever it raises: it is set aside with the reason
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": frame["path"], "text": texts, "error": errors})

    return run


def docx_files(spark: SparkSession, folder: str, done: DataFrame | None = None, doc: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text, error of the *.docx and *.doc files of a folder, of each kind those in the folder itself, or, if it has
    none, all below it. A file that can't be read has its reason in error.

    done: path, text, error as converted before; those paths aren't converted again. Files are known by their whole path, so
    equal names in two folders stay two documents."""
    files = _found(spark, folder, "*.docx").unionByName(_found(spark, folder, "*.doc")).select("path", "content")
    if done is not None:
        files = files.join(done.filter("error is null").select("path"), "path", "left_anti")
    out = files.mapInPandas(_converted(doc), _READ)
    return out if done is None else out.unionByName(done.filter("error is null").select("path", "text", "error"))


def target_texts(spark: SparkSession, path: str, doc: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text of a target: a text or word file, or a folder of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    texts = files.filter("endswith(path, '.txt')").mapInPandas(_decoded, _READ)
    words = files.filter("endswith(path, '.docx') or endswith(path, '.doc')").mapInPandas(_converted(doc), _READ)
    return texts.unionByName(words).filter("error is null").select("path", "text")


def set_aside(files: DataFrame) -> DataFrame:
    """path, error of the files that couldn't be read."""
    return files.filter("error is not null").select("path", "error")


def loaded(spark: SparkSession, folder: str, done: DataFrame | None = None, doc: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text, error of a folder's word documents and of its text files, less those that hold a loaded document's text
    (same path but for the ending)."""
    docs = docx_files(spark, folder, done, doc)
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    have = docs.filter("error is null").select(stem("path").alias("_stem")).distinct()
    texts = text_files(spark, folder).withColumn("_stem", stem("path")).join(have, "_stem", "left_anti").drop("_stem")
    return docs.unionByName(texts)


def reference_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, source, text: the readable word documents and text files of a folder, see named_texts."""
    return named_texts(loaded(spark, folder))


def named_texts(files: DataFrame) -> DataFrame:
    """path, text, error -> path, source, text of the readable ones. Of documents with one short name (stem, 40 characters)
    the last by path stays."""
    docs = files.filter("error is null").select("path", "text")
    named = docs.withColumn("source", F.left(F.regexp_extract("path", _STEM, 1), F.lit(40)))
    return named.groupBy("source").agg(F.max_by(F.struct("path", "text"), "path").alias("f")).select("f.path", "source", "f.text")


def annotation_rows(lines: DataFrame) -> DataFrame:
    """Lines (value) of JSON -> claim_text, expected_status, expected_source, miss_type, note, test_set.
    Blank lines, comments, damaged lines and lines without the three required fields are left out."""
    schema = "`声明文本` string, `期望状态` string, `期望出处` struct<sourcePath:string,`片段`:string>, `漏检类型` string, `备注` string, `测试集` string"
    text = trimmed(F.col("value"))
    rows = lines.select(text.alias("value")).filter("value <> '' and not startswith(value, '#')").select(F.from_json("value", schema).alias("r")).select("r.*")
    rows = rows.filter("`声明文本` is not null and `期望状态` is not null and `漏检类型` is not null")
    source = F.when(F.col("期望出处").isNotNull(), F.struct(F.col("期望出处.sourcePath").alias("source_path"), F.col("期望出处.片段").alias("snippet")))
    return rows.select(F.col("声明文本").alias("claim_text"), F.col("期望状态").alias("expected_status"), source.alias("expected_source"), F.col("漏检类型").alias("miss_type"), F.col("备注").alias("note"), F.col("测试集").alias("test_set"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return annotation_rows(spark.read.text(path))


def word_rows(config: dict) -> list[tuple[str, str | None, str]]:
    """(section, subsection, word) of a nested or flat configuration; words of one character are left out."""
    out = []
    for section, content in (config or {}).items():
        groups = content.items() if isinstance(content, dict) else [(None, content)]
        for name, items in groups:
            out += [(section, name, w.strip()) for w in items or [] if isinstance(w, str) and len(w.strip()) >= 2]
    return out


def words_in(spark: SparkSession, explicit: str | None = None, beside: str | None = None) -> DataFrame:
    """Category words of the file named, else of the one beside the reference texts, else none (the built-in list holds
    in any case)."""
    for path in (explicit, beside and f"{beside.rstrip('/')}/entity_config.yaml"):
        if path and (path == explicit or Path(path).exists()):
            return read_words(spark, path)
    return spark.createDataFrame([], "section string, subsection string, word string")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Category words of a YAML file (a small configuration, read on the driver)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame(word_rows(yaml.safe_load(f)), "section string, subsection string, word string")


def write_checks(claims: DataFrame, folder: str) -> None:
    """All claims, and those with warnings, as JSON lines."""
    claims.write.mode("overwrite").json(f"{folder}/checklist_result")
    claims.filter("size(warnings) > 0").write.mode("overwrite").json(f"{folder}/suspicious")


def read_checks(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Claims written before, for reports to be made anew."""
    return spark.read.schema(schema).json(f"{folder}/checklist_result")


def write_markdown(lines: DataFrame, folder: str, within: str = "target_path") -> None:
    """Report lines (section_no, item_no, line_no, line) as a text folder a target, in order within a file.

    A target's lines lie in one file; targets are spread over the tasks."""
    name = F.regexp_replace(F.regexp_extract(within, _STEM, 1), r"[^\w一-鿿-]", "_").alias("target")
    rows = lines.select(name, "section_no", "item_no", "line_no", F.col("line").alias("value"))
    rows.repartition("target").sortWithinPartitions("target", "section_no", "item_no", "line_no").select("target", "value").write.mode("overwrite").partitionBy("target").text(folder)
