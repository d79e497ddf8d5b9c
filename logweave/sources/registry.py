"""Dataset registry (S7): log format and fixed-depth miner settings per dataset.

Used as a plain Python mapping that drives the format split (S2), the user
masks (M2) and the miner parameters; ``registry_frame`` exposes it as a small
DataFrame for joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.logformat import compile_format, py_strip


@dataclass(frozen=True)
class DatasetSettings:
    log_format: str
    masks: tuple[str, ...] = field(default_factory=tuple)
    st: float = 0.5
    depth: int = 4


# ---------------------------------------------------------------------------
# FIXED VALUES: the benchmark datasets' log formats and fixed-depth settings
# (user masks, similarity threshold, depth), as published with the benchmark.
# ---------------------------------------------------------------------------
DATASETS: dict[str, DatasetSettings] = {
    "HDFS": DatasetSettings("<Date> <Time> <Pid> <Level> <Component>: <Content>",
                            (r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"), 0.5, 4),
    "Hadoop": DatasetSettings(r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
                              (r"(\d+\.){3}\d+",), 0.5, 4),
    "Spark": DatasetSettings("<Date> <Time> <Level> <Component>: <Content>", (), 0.5, 4),
    "Zookeeper": DatasetSettings(r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
                                 (r"(/|)(\d+\.){3}\d+(:\d+)?",), 0.5, 4),
    "BGL": DatasetSettings("<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> "
                           "<Content>", (r"core\.\d+",), 0.5, 4),
    "HPC": DatasetSettings("<LogId> <Node> <Component> <State> <Time> <Flag> <Content>", (r"=\d+",), 0.5, 4),
    "Thunderbird": DatasetSettings(r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> "
                                   r"<Component>(\[<PID>\])?: <Content>", (r"(\d+\.){3}\d+",), 0.5, 4),
    "Windows": DatasetSettings("<Date> <Time>, <Level>                  <Component>    <Content>",
                               (r"0x.*?\s",), 0.7, 5),
    "Linux": DatasetSettings(r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
                             (r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}"), 0.39, 6),
    "Android": DatasetSettings("<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
                               (r"(/[\w-]+)+", r"([\w-]+\.){2,}[\w-]+",
                                r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b"), 0.2, 6),
    "HealthApp": DatasetSettings(r"<Time>\|<Component>\|<Pid>\|<Content>", (), 0.2, 4),
    "Apache": DatasetSettings(r"\[<Time>\] \[<Level>\] <Content>", (r"(\d+\.){3}\d+",), 0.5, 4),
    "Proxifier": DatasetSettings(r"\[<Time>\] <Program> - <Content>",
                                 (r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"),
                                 0.6, 3),
    "OpenSSH": DatasetSettings(r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
                               (r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"), 0.6, 5),
    "OpenStack": DatasetSettings(r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
                                 (r"((\d+\.){3}\d+,?)+", r"/.+?\s", r"\d+"), 0.5, 5),
    "Mac": DatasetSettings(r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
                           (r"([\w-]+\.){2,}[\w-]+",), 0.7, 6),
}
# ---------------------------------------------------------------------------


def settings(name: str) -> DatasetSettings:
    return DATASETS[name]


def registry_frame(spark: SparkSession) -> DataFrame:
    rows = [(k, v.log_format, list(v.masks), float(v.st), int(v.depth)) for k, v in DATASETS.items()]
    return spark.createDataFrame(rows, "dataset string, log_format string, masks array<string>, st double, "
                                       "depth int")


def layout_frame(spark: SparkSession) -> DataFrame:
    """One row per dataset: the split pattern, the group of the content and of the optional header (0: none),
    user masks and miner settings, as columns to join lines with."""
    rows = []
    for name, d in DATASETS.items():
        f = compile_format(d.log_format)
        optional = [g for g, o in zip(f.groups, f.optional, strict=True) if o]
        rows.append((name, f.pattern, f.group_of("Content"), optional[0] if optional else 0, list(d.masks), float(d.st), int(d.depth)))
    return spark.createDataFrame(rows, "dataset string, pattern string, content_group int, optional_group int, masks array<string>, st double, depth int")


def split_by_layout(lines: DataFrame, layouts: DataFrame, value: str = "value", dataset: str = "dataset") -> DataFrame:
    """Lines of many formats in one plan: adds ``content`` and ``optional`` (NULL where absent), ``masked``
    by the dataset's masks in order, ``st`` and ``depth``; lines that do not match their format go.

    The layouts are a table of a row per dataset, so the join is a broadcast by its size.
    """
    d = lines.join(layouts.withColumnRenamed("dataset", "_dataset"), F.col(dataset) == F.col("_dataset"))
    line = py_strip(F.col(value))
    d = d.where(F.regexp_like(line, F.col("pattern")))
    d = d.withColumn("content", F.call_function("regexp_extract", line, F.col("pattern"), F.col("content_group")))
    extra = F.call_function("regexp_extract", line, F.col("pattern"), F.col("optional_group"))
    d = d.withColumn("optional", F.when((F.col("optional_group") > 0) & (extra != ""), extra))
    masked = F.aggregate("masks", F.col("content"), lambda text, mask: F.regexp_replace(text, mask, F.lit("<*>")))
    return d.withColumn("masked", masked).select(*lines.columns, "content", "optional", "masked", "st", "depth")
