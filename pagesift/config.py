"""Settings of the pipeline, as one frozen value that operators take their defaults from."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    fetch_count: int = 29
    deliver: int = 15
    per_host: int = 2
    least_score: float = 0.4
    least_overlap: int = 3
    least_terms: int = 2
    least_front_hits: int = 2
    weight_form: float = 0.50
    weight_authority: float = 0.40
    weight_coverage: float = 0.10
    gate_least_items: int = 10
    gate_least_kept: int = 5
    output_chars: int = 60_000
    cut_remainder: int = 100
    similar: float = 0.60
    hamming: int = 4
    sample_chars: int = 512
    body_budget: int = 1_500_000
    pdf_quota: int = 6_000
    most_hosts: int = 1_000
