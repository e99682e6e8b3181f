"""Declared schemas of the stored tables.  Readers never infer types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


CORPUS = _struct(("text", _S), ("class", _S))

SPLIT_FILE = _struct(
    ("total_samples", _L), ("train_size", _L), ("val_size", _L), ("test_size", _L), ("random_seed", _L),
    ("train_indices", T.ArrayType(_L)), ("val_indices", T.ArrayType(_L)), ("test_indices", T.ArrayType(_L)),
)

PREDICTIONS = _struct(
    ("id", _L), ("text", _S), ("predicted_class", _I), ("predicted_label", _S), ("confidence", _D),
    ("method", _S), ("highlighted_html", _S), ("timestamp", _TS), ("session_id", _S), ("user_agent", _S),
)

REVIEWS = _struct(
    ("id", _L), ("prediction_id", _L), ("correct_class", _I), ("correct_label", _S),
    ("feedback_type", _S), ("teacher_notes", _S), ("timestamp", _TS), ("email", _S),
)

RETRAINING_HISTORY = _struct(
    ("id", _L), ("feedback_ids", _S), ("num_samples", _L), ("model_name", _S), ("training_config", _S),
    ("performance_metrics", _S), ("timestamp", _TS), ("status", _S),
)

CONTACTS = _struct(
    ("id", _L), ("name", _S), ("email", _S), ("subject", _S), ("message", _S), ("submission_type", _S),
    ("error_details", _S), ("timestamp", _TS), ("status", _S), ("response", _S),
)

FEEDBACK = _struct(
    ("id", _L), ("text", _S), ("original_prediction", _S), ("original_score", _D),
    ("original_confidence", _D), ("teacher_correction", _S), ("teacher_notes", _S), ("teacher_id", _S),
    ("prediction_metadata", _S), ("is_correct", _B), ("created_at", _TS), ("reviewed_at", _TS),
    ("status", _S), ("used_for_training", _B),
)

FEEDBACK_STATS = _struct(
    ("date", _S), ("total_feedback", _L), ("correct_predictions", _L), ("incorrect_predictions", _L),
    ("accuracy_rate", _D), ("low_correct", _L), ("low_incorrect", _L), ("medium_correct", _L),
    ("medium_incorrect", _L), ("high_correct", _L), ("high_incorrect", _L),
)

VISITORS = _struct(
    ("id", _L), ("ip_address", _S), ("user_agent", _S), ("path", _S), ("method", _S), ("browser", _S),
    ("device_type", _S), ("os", _S), ("timestamp", _TS), ("led_to_analysis", _B),
)

_EVAL = _struct(
    ("eval_loss", _D), ("eval_accuracy", _D), ("eval_precision", _D), ("eval_recall", _D), ("eval_f1", _D),
    ("eval_fnr", _D), ("eval_fpr", _D), ("eval_true_positives", _L), ("eval_true_negatives", _L),
    ("eval_false_positives", _L), ("eval_false_negatives", _L), ("eval_runtime", _D),
    ("eval_samples_per_second", _D), ("eval_steps_per_second", _D), ("epoch", _D),
)

RESULTS_DOCUMENT = _struct(
    ("model_type", _S), ("model_name", _S), ("seed", _L), ("val_results", _EVAL), ("test_results", _EVAL),
    ("training_config", _struct(
        ("learning_rate", _D), ("batch_size", _L), ("epochs", _L), ("max_seq_length", _L))),
)

MODEL_PREDICTIONS = _struct(
    ("model", _S), ("key", _L), ("pred", _I), ("prob", _D), ("truth", _I),
)
