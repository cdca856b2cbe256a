"""Descriptors of sources and the choices that are made on the driver before any plan exists."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Kinds of data that pre-training corrupts; they are kept whatever tasks are asked for.
PRETRAINING = ("denoising", "mixed", "continuation")


@dataclass(frozen=True)
class SourceConfig:
    """Where a source's rows are and which columns mean what."""

    name: str
    pattern: str
    weight: float
    data_type: str
    text_field: str = "text"
    metadata_field: str | None = "url"
    target_field: str | None = None
    year_field: str | None = None
    sentence1_field: str | None = None
    sentence2_field: str | None = None
    score_field: str | None = None
    extra_columns: tuple[str, ...] = ()
    eval_pattern: str | None = None
    test_pattern: str | None = None
    has_stratified_split: bool = False

    @property
    def required_columns(self) -> list[str]:
        """Columns that a scan reads, each once, in the order of the fields."""
        fields = (self.text_field, self.metadata_field, self.target_field, self.year_field, self.sentence1_field, self.sentence2_field, self.score_field)
        return list(dict.fromkeys(c for c in (*fields, *self.extra_columns) if c))


def parse_tasks(tasks: str) -> set[str] | None:
    """Names of a comma-separated list; null for all, empty for none."""
    text = tasks.strip().lower()
    return None if text == "all" else set() if text in ("", "none") else {t.strip() for t in text.split(",") if t.strip()}


def select_sources(sources: list[SourceConfig], tasks: str, by_name: bool = False) -> list[SourceConfig]:
    """Sources of the tasks by kind (or by name as well); those of pre-training always stay."""
    wanted = parse_tasks(tasks)
    fits = lambda s: wanted is None or s.data_type in wanted or by_name and s.name in wanted
    return [s for s in sources if s.data_type in PRETRAINING or fits(s)]


def named_like(sources: list[SourceConfig], part: str) -> list[SourceConfig]:
    return [s for s in sources if part in s.name]


def split_sources(sources: list[SourceConfig], split: str) -> list[SourceConfig]:
    """Eval or test sources of training sources that have a pattern for them, with the split behind their names."""
    pattern = {"eval": "eval_pattern", "test": "test_pattern"}[split]
    return [replace(s, name=f"{s.name}_{split}", pattern=getattr(s, pattern), eval_pattern=None, test_pattern=None) for s in sources if getattr(s, pattern)]


def pretraining_sources(root: str, tasks: str = "all") -> list[SourceConfig]:
    """A mixture of curated, web, pdf and historical text, and supervised tasks under one folder."""
    at = lambda name, split="train": f"{root}/{name}/{split}/*.parquet"
    both = lambda name: {"eval_pattern": at(name, "eval"), "has_stratified_split": True}
    made = [
        SourceConfig("curated", at("curated"), 0.30, "mixed", "original_text", "metadata", extra_columns=("source", "sentences", "morphs", "sequence_length", "index")),
        SourceConfig("web", at("web"), 0.25, "denoising"),
        SourceConfig("pdf", at("pdf"), 0.15, "denoising"),
        SourceConfig("historical", at("historical"), 0.10, "denoising", metadata_field="source", year_field="year"),
        SourceConfig("sts", at("sts"), 0.05, "sts", "input_text", None, "target_text", None, "sentence1", "sentence2", "rounded_score", **both("sts")),
        SourceConfig("topics", at("topics"), 0.05, "topic_classification", "input_text", "task", "target_text", **both("topics")),
        SourceConfig("nli", at("nli"), 0.10, "nli", "input_text", "task", "target_text", **both("nli")),
    ]
    return select_sources(made, tasks)


def supervised_sources(root: str, tasks: str = "all", split: str = "train") -> list[SourceConfig]:
    """Supervised sources under one folder, of one split."""
    at = lambda name: f"{root}/{name}/{split}/*.parquet"
    made = [
        SourceConfig("temporal", at("temporal"), 0.15, "temporal_classification", metadata_field="source", target_field="label", year_field="year"),
        SourceConfig("sts", at("sts"), 0.10, "sts", "input_text", None, "target_text", None, "sentence1", "sentence2", "rounded_score"),
        SourceConfig("topics", at("topics"), 0.10, "topic_classification", "input_text", "task", "target_text"),
        SourceConfig("nli", at("nli"), 0.10, "nli", "input_text", "task", "target_text"),
        SourceConfig("transcription_articles", at("transcription_articles"), 0.10, "transcription", "target", None, "target"),
        SourceConfig("transcription_sentences", at("transcription_sentences"), 0.10, "transcription", "target", None, "target"),
        SourceConfig("instruction", at("instruction"), 0.15, "instruction", "input_text", "instruction", "target_text"),
        SourceConfig("summaries", at("summaries"), 0.05, "summarization", "text", "source", "summary"),
        SourceConfig("cot", at("cot"), 0.10, "cot", "input_text", "task", "target_text", extra_columns=("thinking",)),
        SourceConfig("choices", at("choices"), 0.05, "multiple_choice", "input_text", None, "target_text"),
    ]
    return select_sources(made, tasks, by_name=True)


def eval_sources(root: str, tasks: str = "all") -> list[SourceConfig]:
    """The four supervised sources that have evaluation rows of their own."""
    return [s for s in supervised_sources(root, tasks, "eval") if s.name in ("sts", "topics", "nli", "temporal")]


def parse_denoisers(text: str) -> list[tuple[float, float]]:
    """Pairs (mean span, ratio) of ``3,8;0.15,0.5``: spans and ratios in pairs, of equal number, ratios in (0, 1)."""
    spans, _, ratios = text.partition(";")
    a, b = [float(x) for x in spans.split(",") if x.strip()], [float(x) for x in ratios.split(",") if x.strip()]
    if not a or len(a) != len(b):
        raise ValueError(f"as many spans as ratios are needed: {text!r}")
    if any(not 0 < x < 1 for x in b) or any(x <= 0 for x in a):
        raise ValueError(f"spans must be positive and ratios between 0 and 1: {text!r}")
    return list(zip(a, b, strict=True))


def align_up(n: int, multiple: int = 128) -> int:
    return -(-n // multiple) * multiple
