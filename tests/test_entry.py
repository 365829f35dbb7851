"""The driver contract: every oracle belongs to a query, and a sample of queries agrees with its oracle on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from rolloutframe.sources.carriers import TABLES

SOME = ["D01_group_mean_advantage", "D02_length_shaped_advantage", "D07_two_level_metrics", "D13_pass_at_k", "D06_pool_metrics_rollup", "C01_restore_pools", "G02_interleave_all_exhausted", "H03_interleave", "I03_bins_hold_every_sample", "I14_cat_packing"]
SOME += ["A04_provenance", "A09_jsonl_pool_restore", "A16_next_batches_once", "A19_sample_table", "A37_checkpoint", "B02_repetition_filter", "B25_stackable", "C08_first_seen_index", "C12_adapter_match", "D25_validation_mean", "E04_rolling_throughput", "E09_horizontal_offsets", "E14_adjacent_groups", "F06_full_batches", "F10_weighted_env_draws", "F11_uniform_examples", "F14_epoch_shuffle", "F16_top_k_experts", "G01_interleave_first_exhausted"]
SOME += ["H01_filled_tokens", "H04_merge_rule", "H06_midgen_starts_a_sample", "H08_event_coercion", "H09_summary_samples", "H10_call_records", "H14_image_indices", "H21_filler_padding", "H23_trim_last_call", "I07_single_run_packer", "I10_horizontal_groups", "I12_vertical_stack_with_calls", "J01_message_containers", "J02_tool_arguments", "J05_tool_format", "K01_continuous_batches", "K13_run_lifecycle", "L02_custom_loss", "L03_filter_protocol"]
SOME += ["A15_socket_micro_batches", "A17_rollout_log_rows", "A34_image_offload", "D29_lag_stats", "H19_shifted_targets", "H20_turn_eviction", "I09_run_progress", "I11_vertical_stack", "K05_restart_at_version", "K08_run_queues", "K10_enough_or_timeout", "K13_state_at_time", "K14_rate_limit", "K15_watchdog_alarms"]
NO_SQL = ["F18_policy_pick", "I15_stack_packing", "J07_hash_mod", "K09_bucket_timeouts"]


def test_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_oracle(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(small, t)}.parquet')")
    got = entry.queries()[name](spark, small)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows], key=repr)
    assert key(got.select(*columns).collect()) == key(want.fetchall())


@pytest.mark.parametrize("name", NO_SQL)
def test_queries_without_sql_run(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0


def test_missing_modules_are_told_from_broken_ones(monkeypatch):
    def fail(name, missing):
        def load(_):
            raise ModuleNotFoundError("no", name=missing)

        monkeypatch.setattr(entry.importlib, "import_module", load)
        return entry._optional(name)

    assert fail("corpus_pipeline", "rolloutframe.llm") is None
    with pytest.raises(ModuleNotFoundError):
        fail("rolloutframe.llm.queries", "numpy")


def test_numbering_needs_no_single_task(spark, small):
    """Windows of one partition see a row for each range, never the table's rows."""
    for name in ("A04_provenance", "E08_exclusive_prefix", "F01_packing_sort", "F08_benchmark_order", "F20_round_robin_clients", "G10_ordered_concat"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert any("_part" in w for w in windows)
        assert all("_part" in w for w in windows), windows


def test_plans_stay_in_the_jvm(spark, small):
    for name in ("D02_length_shaped_advantage", "D13_pass_at_k", "D19_policy_loss", "B02_repetition_filter"):
        plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEval" not in plan
        assert "InArrow" not in plan
