"""The row-local steps on a streaming frame.

Redaction, gate and routing keep no state, so the batch operators apply unchanged; the label medians are a
small static side.  Retrieval stays a batch step: a stream brings its similarity as a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.lexicon import severity
from threadloom.functions.text import redact
from threadloom.operators.gate import gate, route, sla_risk
from threadloom.plans.flows import Lexicons


def route_messages(messages: DataFrame, medians: DataFrame, lex: Lexicons, text: str = "text") -> DataFrame:
    """Messages with intent, confidence and retrieval_similarity in; redacted, gated and routed out."""
    df = redact(messages, text)
    df = df.withColumn("severity", severity(F.col("redacted_text"), lex.severe, lex.frustrated, lex.match))
    df = gate(df, "redacted_text", "intent", "confidence", "severity", lex.rules, lex.prone)
    return route(sla_risk(df, "intent", "redacted_text", "severity", medians, urgency_words=lex.urgency))
