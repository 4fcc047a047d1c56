"""Service calls as tables: what was asked, what came back, what to send again.

A request is known by the hash of its payload, so equal requests are one call. Responses carry the HTTP status, the number of
the attempt and the time they came in; they may repeat, come late or out of order. Every state is derived from the two
tables, so a job that is run again comes to the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST_KEY = "request_key"

# Statuses after which sending the same request again may help.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)

#: States of a call. ``outstanding`` ones are to be sent, ``dead`` ones are given up.
ANSWERED, OUTSTANDING, DEAD = "answered", "outstanding", "dead"


def request_key(payload: Column) -> Column:
    """Hash of a payload struct: its fields by name, NULL fields left out, as they are not sent."""
    return F.sha2(F.to_json(payload), 256)


def keyed(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Requests with the key of the call that serves them."""
    return requests.withColumn(REQUEST_KEY, request_key(F.col(payload)))


def calls(keyed_requests: DataFrame, payload: str = "payload") -> DataFrame:
    """``(request_key, payload, n_requests)``: each different call once, however many requests it serves."""
    return keyed_requests.groupBy(REQUEST_KEY).agg(
        F.first(payload).alias("payload"), F.count(F.lit(1)).alias("n_requests")
    )


def call_states(keyed_requests: DataFrame, responses: DataFrame, is_good: Column, max_attempts: int = 3) -> DataFrame:
    """``(request_key, state, attempts, last_status, response)`` per call.

    ``responses`` holds ``request_key, status, attempt, received, response``. A response counts as good if its status is 2xx and ``is_good``, an expression over
    it, holds: a body without content is no answer. The latest good response wins, whatever failures come after it; of equal times the greater
    attempt, then the greater body. A call without one is outstanding while its last status may be retried and
    fewer than ``max_attempts`` different attempts came back; else it is dead. Responses to calls that nobody asks for are left out. Responses are
    reduced to one row a call before they are joined, so that a call that came back very often is no burden.
    """
    good = F.col("status").between(200, 299) & F.coalesce(is_good, F.lit(False))
    came = F.struct("received", "attempt", F.col("response").alias("body"))
    last = F.struct("received", "attempt", F.col("status").alias("code"))
    attempt_rows = responses.where(F.col(REQUEST_KEY).isNotNull())
    seen = attempt_rows.groupBy(REQUEST_KEY).agg(
        F.max(F.when(good, came)).alias("best"),
        F.max(last).alias("last"),
        F.count_distinct("attempt").alias("attempts"),
    )
    asked = keyed_requests.select(REQUEST_KEY).distinct()
    joined = asked.join(seen, REQUEST_KEY, "left")
    attempts, status = F.coalesce("attempts", F.lit(0)), F.col("last.code")
    # A 2xx without content may be asked for again; so may a call of which nothing has come back.
    retryable = status.isNull() | status.between(200, 299) | status.isin(*RETRYABLE)
    state = F.when(F.col("best").isNotNull(), ANSWERED).when(retryable & (attempts < max_attempts), OUTSTANDING).otherwise(DEAD)
    return joined.select(
        REQUEST_KEY, state.alias("state"), attempts.alias("attempts"), status.alias("last_status"), F.col("best.body").alias("response")
    )


def to_send(keyed_requests: DataFrame, states: DataFrame, payload: str = "payload") -> DataFrame:
    """``(request_key, payload, n_requests, attempt)``: the calls to make now, with the number of their next attempt."""
    waiting = states.where(F.col("state") == OUTSTANDING).select(REQUEST_KEY, (F.col("attempts") + 1).alias("attempt"))
    return calls(keyed_requests, payload).join(waiting, REQUEST_KEY)


def dead_letters(keyed_requests: DataFrame, states: DataFrame) -> DataFrame:
    """Requests whose call was given up, with its attempts and last status."""
    given_up = states.where(F.col("state") == DEAD).select(REQUEST_KEY, "attempts", "last_status")
    return keyed_requests.join(given_up, REQUEST_KEY)


def responded(keyed_requests: DataFrame, states: DataFrame) -> DataFrame:
    """Every request with the ``state`` of its call and the ``response``, NULL unless answered."""
    return keyed_requests.join(states.select(REQUEST_KEY, "state", "attempts", "last_status", "response"), REQUEST_KEY, "left")


def never_asked(keyed_requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses that belong to no request."""
    return responses.join(keyed_requests.select(REQUEST_KEY).distinct(), REQUEST_KEY, "left_anti")
