"""Analytics over an action log: (id, task_id, conversation_id, sequence_id, action_type, status, request_payload, response_payload, created_at, completed_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.clean import clock, excerpt


def seconds_between(a: str | Column, b: str | Column) -> Column:
    at = lambda c: F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
    return (at(b) - at(a)) / 1e6


def sequence_rank(log: DataFrame, conversation: str, sequence: str, created: str) -> DataFrame:
    """Rounds of a conversation: sequences ranked by their first action, then id."""
    first = log.groupBy(conversation, sequence).agg(F.min(created).alias("first_at"))
    return first.withColumn("round", F.dense_rank().over(Window.partitionBy(conversation).orderBy("first_at", sequence)))


def steps(log: DataFrame) -> DataFrame:
    """Actions as they are shown: tool, milliseconds and one text, chosen by the action's type, beside the columns that order them."""
    req = lambda p: F.get_json_object("request_payload", p)
    res = lambda p: F.get_json_object("response_payload", p)
    text = F.when(F.col("action_type") == "user_prompt", req("$.prompt")).when(F.col("action_type") == "tool_call", req("$.arguments")).when(F.col("action_type").isin("answer", "tool_response"), F.coalesce(res("$.text"), F.col("response_payload"))).when(F.col("action_type") == "error", F.col("error")).otherwise(F.coalesce("response_payload", "request_payload"))
    return log.select("conversation_id", "sequence_id", "created_at", "id", "task_id", "action_type", req("$.tool_name").alias("tool"), F.round(seconds_between("created_at", "completed_at") * 1000, 3).alias("ms"), "status", excerpt(text, 120).alias("text"))


def full_trace(log: DataFrame) -> DataFrame:
    """Ordered steps with round, tool, milliseconds and one text, chosen by the action's type."""
    rounds = sequence_rank(log, "conversation_id", "sequence_id", "created_at").drop("first_at")
    step = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "id"))
    return steps(log).join(rounds, ["conversation_id", "sequence_id"]).select("conversation_id", step.alias("step"), "round", "task_id", "action_type", "tool", "ms", "status", "text")


def trace_with_owner(log: DataFrame, tasks: DataFrame, agents: DataFrame) -> DataFrame:
    t, a = tasks.select(F.col("id").alias("task_id"), "agent_id", "role", F.col("created_at").alias("task_at")), agents.select(F.col("id").alias("agent_id"), F.col("name").alias("agent"))
    step = F.row_number().over(Window.partitionBy("task_id").orderBy("created_at", "id"))
    return log.join(t, "task_id").join(a, "agent_id").select("task_id", "agent", "role", "action_type", step.alias("step"), seconds_between("task_at", "created_at").alias("at_seconds"))


def issued_statements(log: DataFrame, tool: str = "query", n: int | None = None) -> DataFrame:
    own = log.where((F.col("action_type") == "tool_call") & (F.get_json_object("request_payload", "$.tool_name") == tool))
    out = own.select("id", "conversation_id", "created_at", F.get_json_object("request_payload", "$.arguments.query").alias("statement"))
    return out if n is None else out.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def action_histogram(log: DataFrame, key: Column, bar: int = 40) -> DataFrame:
    spent = seconds_between("created_at", "completed_at")
    return log.groupBy(key.alias("action")).agg(F.count("*").alias("n"), F.round(F.avg(spent) * 1000, 3).alias("avg_ms"), F.round(F.sum(spent), 3).alias("total_s")).withColumn("bar", F.expr(f"repeat('#', cast(least(n, {bar}) as int))"))


def compare_agents(log: DataFrame, tasks: DataFrame) -> DataFrame:
    """Averages by agent of totals by task: a task counts once, however many actions it has."""
    by_task = log.groupBy("task_id").agg(F.count("*").alias("actions"), F.count_if(F.col("action_type") == "tool_call").alias("tool_calls"))
    joined = tasks.select(F.col("id").alias("task_id"), "agent_id").join(by_task, "task_id", "left").na.fill(0, ["actions", "tool_calls"])
    return joined.groupBy("agent_id").agg(F.count("*").alias("tasks"), F.round(F.avg("actions"), 6).alias("avg_actions"), F.round(F.avg("tool_calls"), 6).alias("avg_tool_calls"))


def budget_headroom(log: DataFrame, tasks: DataFrame, agents: DataFrame, default_cap: int = 21) -> DataFrame:
    """Iterations used against the cap, the default where none is set; all agents stay."""
    used = log.where("action_type = 'model_request'").groupBy("task_id").agg(F.count("*").alias("iterations"))
    t = tasks.select(F.col("id").alias("task_id"), "agent_id", "budget_consumed").join(used, "task_id", "left").na.fill(0, ["iterations"])
    worst = t.groupBy("agent_id").agg(F.max("iterations").alias("worst"), F.round(F.avg("iterations"), 6).alias("mean"), F.max("budget_consumed").alias("worst_tokens"))
    a = agents.select(F.col("id").alias("agent_id"), "name", F.coalesce("max_iterations", F.lit(default_cap)).alias("cap"), F.col("max_iterations").isNull().alias("implicit"))
    return a.join(worst, "agent_id", "left").withColumn("headroom", F.col("cap") - F.col("worst"))


def run_costs(log: DataFrame, tasks: DataFrame, agents: DataFrame, n: int = 20) -> DataFrame:
    used = log.groupBy("task_id").agg(F.count_if(F.col("action_type") == "model_request").alias("iterations"))
    t = tasks.withColumnRenamed("id", "task_id").join(used, "task_id", "left").join(agents.select(F.col("id").alias("agent_id"), F.col("name").alias("agent"), "input_token_budget", "timeout_seconds"), "agent_id", "left")
    return t.select("task_id", "agent", "budget_consumed", "input_token_budget", F.coalesce("iterations", F.lit(0)).alias("iterations"), seconds_between("created_at", "completed_at").alias("wall_s"), "timeout_seconds", "created_at").orderBy(F.col("created_at").desc_nulls_first(), "task_id").limit(n)


def param_count(params: str | Column) -> Column:
    """Parameters of mixed JSON: an array's length, an object's number of required ones, else 0."""
    p = F.col(params) if isinstance(params, str) else params
    return F.when(F.btrim(p).startswith("["), F.coalesce(F.json_array_length(p), F.lit(0))).otherwise(F.coalesce(F.json_array_length(F.get_json_object(p, "$.required")), F.lit(0)))


def session_purpose(sessions: DataFrame) -> DataFrame:
    """runtime:purpose out of an application's name, and the age in seconds."""
    return sessions.select("pid", "usename", F.split_part("application_name", F.lit(":"), F.lit(1)).alias("runtime"), F.nullif(F.split_part("application_name", F.lit(":"), F.lit(2)), F.lit("")).alias("purpose"), "state", seconds_between("backend_start", F.current_timestamp()).alias("age_s"))


def actors_union(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).distinct().unionByName(b.select(*columns).distinct())


ANSWER = T.StructType([T.StructField("answer", T.StringType()), T.StructField("sql", T.StringType()), T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())])


def parse_answers(log: DataFrame) -> DataFrame:
    parsed = log.where("action_type = 'answer'").select("id", "conversation_id", F.from_json("response_payload", ANSWER).alias("a"))
    return parsed.select("id", "conversation_id", "a.*")


#: Tools that fetch definitions before a statement is written (fixed values).
GROUNDING = ("semantic_kb_search", "get_column_definitions", "get_entity_definitions", "search_by_comment", "get_metadata", "semantic_kb_stats")


def grounding_calls(log: DataFrame, tools: tuple = GROUNDING) -> DataFrame:
    """What was looked up, in order, by conversation: tool, question and what came back."""
    tool = F.get_json_object("request_payload", "$.tool_name")
    own = log.where(F.col("action_type").isin("tool_call", "tool_response") & tool.isin(*tools))
    step = F.row_number().over(Window.partitionBy("conversation_id").orderBy("created_at", "id"))
    asked, got = F.get_json_object("request_payload", "$.arguments.query_text"), F.get_json_object("response_payload", "$.contents")
    return own.select("conversation_id", "id", step.alias("step"), tool.alias("tool"), excerpt(asked, 80).alias("asked_for"), excerpt(got, 130).alias("retrieved"))


def agent_registry(agents: DataFrame) -> DataFrame:
    """Agents with counts of their tools and delegates; without a role they run as their caller."""
    counted = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return agents.select("name", "model", counted("tools").alias("n_tools"), counted("delegates").alias("n_delegates"), "max_iterations", F.col("output_type").isNotNull().alias("structured_output"), F.coalesce("role", F.lit("(caller)")).alias("runs_as"))


def tool_registry(tools: DataFrame, k: int = 40) -> DataFrame:
    """Tools by kind and name, with the number of their parameters, whichever of both shapes these have."""
    shape = F.when(F.btrim("params").startswith("["), "array").when(F.btrim("params").startswith("{"), "object")
    return tools.select("tool_type", "name", "read_only", param_count("params").alias("n_params"), shape.alias("params_shape"), F.left(F.coalesce("description", F.lit("")), F.lit(58)).alias("description")).orderBy("tool_type", "name").limit(k)


def conversation_list(conversations: DataFrame, agents: DataFrame, k: int = 15) -> DataFrame:
    a = agents.select(F.col("id").alias("agent_id"), F.col("name").alias("agent"))
    newest = conversations.orderBy(F.desc_nulls_first("created_at"), "conversation_id").limit(k)
    return newest.join(a, "agent_id").select("conversation_id", "agent", "status", "message_count", "created_at", "updated_at")


def task_list(tasks: DataFrame, agents: DataFrame, k: int = 15) -> DataFrame:
    """The newest tasks as a customer sees them; a task without an error says so."""
    a = agents.select(F.col("id").alias("agent_id"), F.col("name").alias("agent"))
    newest = tasks.orderBy(F.desc_nulls_first("created_at"), "id").limit(k)
    return newest.join(a, "agent_id").select(F.col("id").alias("task_id"), "agent", "role", "status", clock("created_at").alias("created"), clock("completed_at").alias("completed"), F.coalesce("error", F.lit("(none)")).alias("error"))


def transcript(turns: DataFrame, kind: str, kinds: tuple, text: str, keys: list[str], width: int = 150) -> DataFrame:
    """What a user sees of a conversation: prompts and answers, cut to a line."""
    return turns.where(F.col(kind).isin(*kinds)).select(*keys, kind, excerpt(text, width).alias("text"))


def latest_conversation(log: DataFrame, agent_id: object | None = None) -> DataFrame:
    """The log of the conversation with the newest action, of one agent if asked."""
    own = log if agent_id is None else log.where(F.col("agent_id") == agent_id)
    newest = own.agg(F.max_by("conversation_id", F.struct("created_at", "id")).alias("conversation_id"))
    return log.join(F.broadcast(newest), "conversation_id", "left_semi")  # one row


def live_trace(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Queued actions that the log does not have yet, and the log: a running conversation as a whole."""
    waiting = queue.join(log.select("id"), "id", "left_anti").withColumn("in_flight", F.lit(True))
    return waiting.unionByName(log.withColumn("in_flight", F.lit(False)), allowMissingColumns=True)


def session_counts(sessions: DataFrame) -> DataFrame:
    """Connections by user, application and state."""
    return sessions.groupBy("usename", "application_name", "state").agg(F.count("*").alias("n"))


def elapsed_steps(df: DataFrame, key: str, at: str, id_col: str) -> DataFrame:
    """Steps of a key from 1, ties by id, and seconds since its first."""
    w = Window.partitionBy(key)
    return df.select(id_col, key, F.row_number().over(w.orderBy(at, id_col)).alias("step"), seconds_between(F.min(at).over(w), at).alias("at_seconds"))
