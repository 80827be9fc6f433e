from gradewell.functions.hashing import row_hash, unit_hash
from gradewell.functions.scores import logistic, positive_probability
from gradewell.functions.weights import bin_measures

__all__ = ["row_hash", "unit_hash", "logistic", "positive_probability", "bin_measures"]
