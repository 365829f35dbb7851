"""Record types as DDL strings. Token ids are ints, counts longs, log probabilities and rewards doubles."""

EVENT = (
    "struct<num_output_tokens_at_compaction: int, tokens_evicted: int, position_offset_after: int, num_prompt_tokens: int, "
    "evict_start: int, new_user_fragment_len: int, kept_indices: array<int>, kept_token_ids: array<int>, last_turn_evicted: int, "
    "num_turns_evicted_after: int, archived_span_ids: array<string>, archived_span_bounds: array<int>, event_kind: int, "
    "restored_span_ids: array<string>, visibility_boundary_computed: int, restored_span_token_ids: array<int>, restored_span_pos_start: int>"
)
CALL = (
    "struct<submitted_prompt_ids: array<int>, completion_ids: array<int>, completion_logprobs: array<double>, "
    f"completion_temperatures: array<double>, compaction_events: array<{EVENT}>, trailing_pad_ids: array<int>>"
)
MESSAGE = "struct<role: string, content: string>"
TOKENS = (
    "struct<prompt_ids: array<int>, prompt_mask: array<boolean>, completion_ids: array<int>, completion_mask: array<boolean>, "
    "completion_logprobs: array<double>, overlong_prompt: boolean, is_truncated: boolean>"
)
STEP = f"struct<prompt: array<{MESSAGE}>, completion: array<{MESSAGE}>, tokens: {TOKENS}, reward: double, advantage: double, is_truncated: boolean, trajectory_id: string, extras: string>"
ROLLOUT = (
    "example_id bigint, env_name string, task string, reward double, error string, stop_condition string, is_truncated boolean, "
    f"sampling_args struct<temperature: double>, metrics map<string,double>, timing struct<generation_ms: double, scoring_ms: double>, trajectory array<{STEP}>"
)
SAMPLE = (
    "prompt_ids array<int>, prompt_mask array<boolean>, completion_ids array<int>, completion_mask array<boolean>, "
    "completion_logprobs array<double>, completion_temperatures array<double>, teacher_logprobs array<double>, advantage double, reward double"
)
MICRO_BATCH = (
    "input_ids array<int>, loss_mask array<boolean>, advantages array<double>, inference_logprobs array<double>, position_ids array<int>, "
    "temperatures array<double>, teacher_logprobs array<double>, lora_num_tokens array<int>"
)
SFT_SAMPLE = "input_ids array<int>, target_ids array<int>, loss_mask array<boolean>, position_ids array<int>"
SAMPLE_LOG = (
    "run_id string, step bigint, tag string, problem_id bigint, sample_id bigint, prompt string, completion string, trajectory string, "
    "answer string, task string, info string, reward double, advantage double, metrics string, timing string, num_input_tokens bigint, "
    "num_output_tokens bigint, created_at timestamp, env_name string"
)
