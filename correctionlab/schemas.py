"""Row schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _struct(required: dict[str, T.DataType], optional: dict[str, T.DataType] | None = None) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    fields += [T.StructField(n, t, True) for n, t in (optional or {}).items()]
    return T.StructType(fields)


SCORES = _struct(
    {"id": _S, "title": _S, "composer": _S, "era": _S, "source": _S, "original_pdf_path": _S,
     "status": _S, "created_at": _TS, "updated_at": _TS},
    {"source_url": _S, "musicxml_path": _S, "metadata_json": T.MapType(_S, _S)},
)
DIFFS = _struct(
    {"id": _S, "score_id": _S, "measure_number": _I, "instrument": _S, "time_signature": _S,
     "key_signature": _S, "difference_type": _S, "description": _S, "pdf_snippet_path": _S,
     "musicxml_snippet_path": _S, "omr_confidence": _D, "vision_confidence": _D,
     "auto_accepted": _B, "created_at": _TS},
    {"human_decision": _S, "human_edit_value": _S, "human_reviewed_at": _TS, "auto_accept_rule_id": _S},
)
PATTERNS = _struct(
    {"id": _S, "pattern_type": _S, "difference_type": _S, "pattern_description": _S,
     "occurrence_count": _L, "accept_count": _L, "reject_count": _L, "edit_count": _L,
     "confidence_threshold": _D, "created_at": _TS, "updated_at": _TS},
    {"instrument": _S, "era": _S, "example_ids": T.ArrayType(_S), "accept_count_exact": _L},
)
RULES = _struct(
    {"id": _S, "pattern_id": _S, "rule_description": _S, "difference_type": _S,
     "min_omr_confidence": _D, "min_vision_confidence": _D, "min_confirmations": _L,
     "current_confirmations": _L, "is_active": _B, "created_at": _TS},
    {"instrument": _S},
)
PROMPT_VERSIONS = _struct(
    {"id": _S, "version": _I, "prompt_text": _S, "total_uses": _L, "is_active": _B, "created_at": _TS},
    {"accept_rate": _D, "reject_rate": _D},
)
FINETUNING_DATASET = _struct(
    {"id": _S, "flagged_diff_id": _S, "image_path": _S, "label": _S, "split": _S},
    {"exported_at": _TS},
)
USERS = _struct({"id": _S, "email": _S, "role": _S})
PAYMENTS = _struct(
    {"id": _S, "user_id": _S, "score_id": _S, "amount_cents": _I, "currency": _S, "status": _S,
     "created_at": _TS},
    {"session_id": _S, "payment_intent": _S, "completed_at": _TS, "metadata_json": T.MapType(_S, _S)},
)
SCORE_ACCESS = _struct(
    {"user_id": _S, "score_id": _S, "feature": _S, "access_type": _S, "granted_at": _TS}, {"id": _S}
)
PARTS = _struct(
    {"score_id": _S, "part_id": _S}, {"part_seq": _I, "part_name": _S, "body_seq": _I, "part_xml": _S}
)
MEASURES = _struct(
    {"score_id": _S, "part_id": _S, "body_seq": _I, "measure_seq": _I, "xml": _S},
    {"part_seq": _I, "part_name": _S, "measure_number": _S},
)
DECISION_LOG = _struct(
    {"diff_id": _S, "score_id": _S, "decision": _S, "kind": _S, "ts": _TS, "event_id": _L},
    {"edit_value": _S},
)
MODEL_RESPONSES = _struct({"score_id": _S, "page_no": _I, "instrument": _S, "response_text": _S})
WORK_PAGES = _struct({"page_id": _L, "url": _S, "html": _S})

TABLES = {
    "scores": SCORES,
    "diffs": DIFFS,
    "patterns": PATTERNS,
    "rules": RULES,
    "prompt_versions": PROMPT_VERSIONS,
    "finetuning_dataset": FINETUNING_DATASET,
    "users": USERS,
    "payments": PAYMENTS,
    "score_access": SCORE_ACCESS,
    "parts": PARTS,
    "measures": MEASURES,
    "decision_log": DECISION_LOG,
    "model_responses": MODEL_RESPONSES,
    "work_pages": WORK_PAGES,
}

WEBHOOK_BODY = T.StructType([
    T.StructField("type", _S),
    T.StructField("data", T.StructType([
        T.StructField("object", T.StructType([
            T.StructField("id", _S),
            T.StructField("payment_intent", _S),
            T.StructField("metadata", T.StructType([
                T.StructField("user_id", _S), T.StructField("score_id", _S),
            ])),
        ])),
    ])),
])
