"""What a provider has to deliver, and the two that come with the library."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from . import parquet_provider, xml_provider


class Provider(Protocol):
    """Events and tracking of any number of matches, as the contracts EVENTS and TRACKING ask."""

    def events(self) -> DataFrame: ...

    def tracking(self) -> DataFrame: ...


@dataclass(frozen=True)
class ParquetProvider:
    """Raw tables: action events, lineups, wide tracking."""

    raw_events: DataFrame
    lineups: DataFrame
    wide: DataFrame
    fps: int = 25

    def refined(self) -> DataFrame:
        p = parquet_provider
        return p.refine_events(p.type_events(p.prepare(self.raw_events, self.lineups)), self.wide)

    def events(self) -> DataFrame:
        return parquet_provider.contract_events(self.refined())

    def tracking(self) -> DataFrame:
        return parquet_provider.contract_tracking(self.wide, self.refined(), fps=self.fps)


@dataclass(frozen=True)
class XmlProvider:
    """Folders (or globs) of lineup, event and tracking files; ``match_of`` finds the match in a file's path."""

    spark: SparkSession
    lineup_path: str
    event_path: str
    tracking_path: str
    match_of: str = xml_provider.MATCH_OF
    fps: int = 25

    def lineup(self) -> DataFrame:
        return xml_provider.read_lineup(self.spark, self.lineup_path, self.match_of)

    def events(self) -> DataFrame:
        e = xml_provider.type_events(xml_provider.read_events(self.spark, self.event_path, self.match_of))
        return xml_provider.contract_events(e, self.lineup())

    def tracking(self) -> DataFrame:
        return xml_provider.contract_tracking(xml_provider.read_tracking(self.spark, self.tracking_path, self.match_of, fps=self.fps), self.lineup(), xml_provider.read_events(self.spark, self.event_path, self.match_of), self.fps)
