"""The steps of one session over one table: load, profile, scan, suggest, clean, augment,
mask. Everything but the two one-row look-ups (profile, suggestion) stays lazy."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from commentmill.operators import augment, clean, profanity, profile, rows, stats
from commentmill.sources import datasets


@dataclass(frozen=True)
class Workbench:
    """A table with its text and label column; each step returns a new one."""

    df: DataFrame
    text_col: str
    label_col: str | None = None
    row_id: str = "row_id"

    @classmethod
    def load(cls, spark: SparkSession, path: str, format: str | None = None,
             **options) -> Workbench:
        return cls.of(datasets.load_dataset(spark, path, format, **options))

    @classmethod
    def of(cls, df: DataFrame, text_col: str | None = None, label_col: str | None = None,
           row_id: str = "row_id") -> Workbench:
        text = text_col or profile.detect_text_column(df)
        label = label_col or profile.detect_label_column(df, text)
        keyed = df if row_id in df.columns else rows.with_row_id(df, row_id)
        return cls(profanity.scan(keyed, text), text, label, row_id)

    @property
    def active(self) -> str:
        return rows.active_text_column(self.df, self.text_col)

    def suggest(self) -> clean.CleanConfig:
        return stats.suggested_config(stats.suggest_cleaning(self.df, self.active))

    def clean(self, cfg: clean.CleanConfig | None = None, **lists) -> Workbench:
        done = clean.clean(self.df, self.active, cfg or self.suggest(), **lists)
        return replace(self, df=rows.drop_stale(done, clean.PROCESSED))

    def augment(self, cfg: augment.AugmentConfig, **options) -> Workbench:
        cfg = replace(cfg, strength=augment.clamp_strength(cfg.strength))
        return replace(self, df=augment.augment(self.df, self.text_col, cfg, key=self.row_id,
                                                **options))

    def scan(self, terms=None) -> Workbench:
        return replace(self, df=profanity.scan(self.df, self.active, terms))

    def sanitize(self, terms=None, **options) -> Workbench:
        return replace(self, df=profanity.sanitize(self.df, self.active, terms, **options))

    def export(self, path: str) -> None:
        datasets.export_csv(self.df, path)
