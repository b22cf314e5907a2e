from .analyze import analyze
from .run import analysis_only, run, study_dataset, validate_only

__all__ = ["analysis_only", "analyze", "run", "study_dataset", "validate_only"]
