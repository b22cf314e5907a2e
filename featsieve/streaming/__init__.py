from .result_log import append_results, completed_combinations, latest_results, pending_combinations

__all__ = ["append_results", "completed_combinations", "latest_results", "pending_combinations"]
