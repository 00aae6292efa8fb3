"""Explicit schemas of every table the library reads."""

from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


RECORD = _struct(
    index=S, origin_query=S, prompt=S, score=D, cost=D, prompt_tokens=L, completion_tokens=L,
)
RESULT_FILE = _struct(
    dataset_name=S, dataset_id=S, split=S, model_name=S, demo=B, records=T.ArrayType(RECORD),
)
SAMPLES = _struct(
    sample_id=S, dataset=S, split=S, record_index=S, query=S, query_hash=S, domain=S,
)
OUTCOMES = _struct(
    sample_id=S, dataset=S, split=S, model=S, score=D, cost=D, prompt_tokens=L, completion_tokens=L,
)
# `probabilities` may be an object or an array; read as text it keeps both forms.
ANSWER = _struct(type=S, noul=D, score=D, confidence=D, probabilities=S)
DECISION = _struct(
    sample_id=S, query_hash=S, probe_set_version=S, backend=S, requested_model=S, resolved_model=S,
    resolved_revision=S, answers=T.MapType(S, ANSWER), usage=_struct(input_tokens=L, output_tokens=L),
    latency_ms=D, cached=B,
)
EMBEDDINGS = _struct(sample_id=S, embedding=T.ArrayType(T.FloatType()))
PREDICTIONS = _struct(
    sample_id=S, selected_model=S, selected_score=D, oracle_score=D, regret=D, prediction_margin=D,
)
