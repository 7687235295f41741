"""A SARIF report of any size: result files written by the tasks, and one root file that names them.

The format's own way for large logs: the root file's run refers to external property files, each with an ``itemCount``, in
place of its results. Tasks write one such file each; the driver sees their names, counts and rule names alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.operators.render import sarif_results

#: The root file's name; ``sarif-log.json`` beside its parts.
ROOT = "sarif-log.json"
_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/os/schemas/sarif-schema-2.1.0.json"


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    guid: str
    results: int
    rules: list[str]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class SarifWriter(DataSourceWriter):
    def __init__(self, path: str):
        self._path, self._run = path.rstrip("/"), str(uuid.uuid4())

    def _put(self, name: str, pieces: Iterator[str]) -> None:
        store, path = _store(self._path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as out:
            for piece in pieces:
                out.write(piece.encode())

    def write(self, iterator: Iterator[Row]) -> Part:
        """One task's results, a piece at a time; a repeated try has a name of its own, which only its commit makes known."""
        rules, guid, n = set(), str(uuid.uuid4()), 0
        first = next(iterator, None)
        if first is None:
            return Part(None, guid, 0, [])

        def pieces() -> Iterator[str]:
            nonlocal n
            yield f'{{"version": "2.1.0", "guid": "{guid}", "runGuid": "{self._run}", "results": ['
            row = first
            while row is not None:
                yield (",\n" if n else "\n") + row["json"]
                rules.add(row["rule"])
                n += 1
                row = next(iterator, None)
            yield "\n]}\n"

        name = f"results-{guid}.json"
        self._put(name, pieces())
        return Part(name, guid, n, sorted(x for x in rules if x is not None))

    def commit(self, messages: list[Part | None]) -> None:
        """The root file, written last: a report without it isn't whole."""
        parts = sorted((x for x in messages if x is not None and x.name is not None), key=lambda x: x.name)
        rules = [{"id": x} for x in sorted({r for p in parts for r in p.rules})]
        files = [{"location": {"uri": p.name}, "guid": p.guid, "itemCount": p.results} for p in parts]
        run = {"automationDetails": {"guid": self._run}, "tool": {"driver": {"name": "quarry", "rules": rules}}}
        run |= {"externalPropertyFileReferences": {"results": files}} if files else {"results": []}
        self._put(ROOT, iter([json.dumps({"$schema": _SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2)]))

    def abort(self, messages: list[Part | None]) -> None:
        store, path = _store(self._path)
        for part in messages:
            if part is not None and part.name is not None:
                store.delete_file(f"{path}/{part.name}")


class SarifSource(DataSource):
    """Format ``quarry_sarif``: writes rows of json (a SARIF result) and rule."""

    @classmethod
    def name(cls) -> str:
        return "quarry_sarif"

    def schema(self) -> str:
        return "json string, rule string"

    def writer(self, schema: StructType, overwrite: bool) -> SarifWriter:
        return SarifWriter(self.options["path"])


def write(findings: DataFrame, path: str) -> None:
    """Writes all ``findings`` as one SARIF log below ``path``, a folder of its own that all nodes share."""
    findings.sparkSession.dataSource.register(SarifSource)
    told = sarif_results(findings)
    rows = told.select("json", F.get_json_object("json", "$.ruleId").alias("rule"))
    rows.write.format("quarry_sarif").mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, level, message, uri, start_line, end_line of the results that the root file below ``path`` names; fails where
    a file's number of results isn't the root's."""
    base = path.rstrip("/")
    root = spark.read.text(f"{base}/{ROOT}", wholetext=True).select(
        F.from_json("value", "runs array<struct<externalPropertyFileReferences:struct<results:array<struct<location:struct<uri:string>,itemCount:long>>>>>").alias("r"))
    named = [(x["location"]["uri"], x["itemCount"]) for x in (root.select("r.runs").first()[0][0]["externalPropertyFileReferences"] or {"results": []})["results"]]
    result = "ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>"
    kind = "struct<" + ",".join(x.strip().replace(" ", ":", 1) for x in result.replace(", ", "\n").split("\n")) + ">"
    if not named:
        return spark.createDataFrame([], "rule_id string, level string, message string, uri string, start_line int, end_line int")
    # a result a line: the first and last lines of a part are its frame
    lines = spark.read.text([f"{base}/{x}" for x, _ in named])
    told = lines.where("value like '{\"ruleId\"%' or value like '{\"message\"%'").select(F.from_json(F.regexp_replace("value", ",$", ""), kind).alias("r"))
    out = told.select(F.col("r.ruleId").alias("rule_id"), "r.level", F.col("r.message.text").alias("message"), F.col("r.locations")[0]["physicalLocation"].alias("p"))
    out = out.select("rule_id", "level", "message", F.col("p.artifactLocation.uri").alias("uri"), F.col("p.region.startLine").alias("start_line"), F.col("p.region.endLine").alias("end_line"))
    whole = sum(n for _, n in named)
    if out.count() != whole:
        raise ValueError(f"{base}: the files named hold another number of results than {whole}")
    return out
