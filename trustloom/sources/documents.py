"""The five nested JSON documents: schemas, reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FILE = "file struct<name:string,meta:string,status:string,timestamp:string,scene:string>"
_SUMMARY = "summary struct<percent:int,label:string,status:string>"
_PAIRS = "array<struct<label:string,value:string>>"
_DRIFT = "array<struct<label:string,reference:double,uploaded:double>>"
_LEVELS = "array<struct<label:string,level:string>>"

SCHEMAS = {
    "dataset": f"{_FILE}, overview {_PAIRS}, quality array<struct<label:string,count:string,percent:int>>, featureDrift {_DRIFT}, "
    f"classDrift {_DRIFT}, domainDrift {_DRIFT}, contributors array<struct<name:string,level:string>>, "
    f"anomalies array<struct<name:string,level:string,icon:string>>, evidence array<struct<scene:string,chip:array<string>>>, {_SUMMARY}",
    "model": f"{_FILE}, overview {_PAIRS}, risks array<struct<label:string,level:string,icon:string>>, trainingRisk {_LEVELS}, {_SUMMARY}",
    "inference": f"{_FILE}, prediction struct<label:string,confidence:int,timestamp:string>, "
    f"provenance array<struct<label:string,value:string,copyable:boolean>>, integrity {_PAIRS}, {_SUMMARY}",
    "dashboard": "kpis array<struct<label:string,value:string,sub:string>>, "
    "recent array<struct<name:string,type:string,score:int,status:string,tone:string,date:string>>",
    "audit": "entries array<struct<timestamp:string,actor:string,action:string,target:string,status:string>>",
}


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per file; a file that is no such document has only ``_corrupt_record``."""
    schema = SCHEMAS[kind] + ", _corrupt_record string"
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)
