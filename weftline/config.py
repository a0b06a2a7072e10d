"""Settings of all operators, frozen, with a fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, is_dataclass


# Thresholds that results depend on.
@dataclass(frozen=True)
class Validation:
    title_min: int = 3
    title_max: int = 300
    body_min: int = 20
    body_max: int = 50_000
    corpus_body_min: int = 250
    max_non_alpha: float = 0.45
    max_upper: float = 0.80
    shingle: int = 3
    near_duplicate: float = 0.60


@dataclass(frozen=True)
class Language:
    target: str = "es"
    supported: tuple[str, ...] = ("es",)
    min_confidence: float = 0.70
    reject_unsupported: bool = True
    min_tokens: int = 5
    min_ratio: float = 0.05


@dataclass(frozen=True)
class Corpus:
    min_page_chars: int = 400
    max_docs_per_seed: int = 6
    min_categories: int = 3
    min_documents: int = 30
    default_extractor: str = "html"
    drop_code_blocks: bool = True
    excluded_sections: tuple[str, ...] = ("véase también", "referencias", "bibliografía", "enlaces externos", "notas", "fuentes", "lecturas adicionales")


@dataclass(frozen=True)
class Nlp:
    title_in_text: bool = False
    title_in_entities: bool = True
    kept_pos: tuple[str, ...] = ("NOUN", "PROPN", "ADJ")
    min_token: int = 3
    entity_labels: tuple[str, ...] = ("TECH", "ORG", "PRODUCT")


@dataclass(frozen=True)
class Embeddings:
    dimension: int = 384
    normalise: bool = True
    model: str = "hashed-tfidf"


@dataclass(frozen=True)
class Keywords:
    top_k: int = 5
    ngram_min: int = 1
    ngram_max: int = 3
    diversity: float = 0.75
    candidates: int = 10
    dedup_limit: float = 0.7
    rrf_k: int = 60
    weight_semantic: float = 1.0
    weight_local: float = 0.8
    weight_entities: float = 2.5
    min_chars: int = 3
    filter_by_pos: bool = True


@dataclass(frozen=True)
class Tfidf:
    ngram_min: int = 1
    ngram_max: int = 3
    min_df: int = 2
    max_df: float = 0.85
    sublinear: bool = True
    max_features: int = 8000


@dataclass(frozen=True)
class Classification:
    test_size: float = 0.25
    folds: int = 5
    max_iter: int = 2000
    c: float = 5.0
    low_confidence: float = 0.25
    calibrate: bool = True
    terms_per_class: int = 8
    ngram_max: int = 2


@dataclass(frozen=True)
class Clustering:
    k_min: int = 2
    k_max: int = 16
    n_init: int = 10
    topic_size_divisor: int = 60
    topic_size_floor: int = 3
    words_per_topic: int = 7
    label_words: int = 4
    components: int = 5
    rescue_outliers: bool = True


@dataclass(frozen=True)
class Vectors:
    metric: str = "cosine"
    search_results: int = 5
    related: int = 3


@dataclass(frozen=True)
class Service:
    title_cut: int = 70
    body_cut: int = 120
    top_categories: int = 3
    ablation_terms: int = 6


@dataclass(frozen=True)
class Config:
    version: str = "1.0"
    seed: int = 42
    validation: Validation = field(default_factory=Validation)
    language: Language = field(default_factory=Language)
    corpus: Corpus = field(default_factory=Corpus)
    nlp: Nlp = field(default_factory=Nlp)
    embeddings: Embeddings = field(default_factory=Embeddings)
    keywords: Keywords = field(default_factory=Keywords)
    tfidf: Tfidf = field(default_factory=Tfidf)
    classification: Classification = field(default_factory=Classification)
    clustering: Clustering = field(default_factory=Clustering)
    vectors: Vectors = field(default_factory=Vectors)
    service: Service = field(default_factory=Service)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False)

    @classmethod
    def from_json(cls, settings: str) -> Config:
        """The settings that to_json() wrote."""
        made = {}
        for name, value in json.loads(settings).items():
            part = getattr(DEFAULT, name)
            fields = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
            made[name] = type(part)(**fields(value)) if is_dataclass(part) else tuple(value) if isinstance(value, list) else value
        return cls(**made)

    def fingerprint(self) -> str:
        """SHA-256 of the settings as JSON with sorted keys."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()


DEFAULT = Config()
