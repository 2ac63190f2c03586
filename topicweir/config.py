"""Settings as frozen dataclasses; every operator also takes them as plain arguments."""

from dataclasses import dataclass


@dataclass(frozen=True)
class TrainSettings:
    max_features: int = 1500
    min_df: int = 2
    max_df: float = 0.9
    ngram_max: int = 4
    teacher_trees: int = 100
    teacher_depth: int = 6
    teacher_rate: float = 0.1
    temperature: float = 2.0
    student_iterations: int = 500
    student_c: float = 0.3
    selected_features: int = 20000
    compressed_features: int = 20000
    test_size: float = 0.2
    seed: int = 42


@dataclass(frozen=True)
class ClassifySettings:
    confidence_rate: float = 10.0
    long_text_chars: int = 1000
    long_text_factor: float = 1.2
    keyword_sure: float = 0.8
    model_cap: float = 0.99
    no_probability: float = 0.7
    quantization: str = "float16"
