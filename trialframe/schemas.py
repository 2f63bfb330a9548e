"""Explicit schemas of the data sets that the operators read and write."""

MESSAGES = "array<struct<role: string, content: string>>"

SFT_RECORDS = (
    "id string, task_family string, complexity string, constraint_types array<string>, "
    f"messages {MESSAGES}, prompt string, canonical_code string, "
    "meta struct<num_trials: int, num_factors: int, exec_time_sec: double>"
)
PREFERENCE_PAIRS = (
    f"id string, task_family string, prompt string, chosen {MESSAGES}, rejected {MESSAGES}, rejected_error string"
)
GRADE = (
    "passed boolean, score double, syntax_valid boolean, ast_parsed boolean, imports_valid boolean, "
    "block_created boolean, synthesized boolean, num_trials int, num_factors int, error_type string, "
    "error_message string, execution_time_sec double, raw_output string"
)
TRIALS = (
    "id string, task_family string, complexity string, prompt string, generated_completion string, "
    "passed boolean, score double, syntax_valid boolean, ast_parsed boolean, block_created boolean, "
    "synthesized boolean, num_trials int, error_type string, error_message string, gen_time_sec double, "
    "exec_time_sec double"
)
EVAL_SUMMARY = (
    "num_eval_samples bigint, pass_rate_pass_at_1 double, mean_stepped_score double, total_eval_time_sec double, "
    "generation_time_sec double, grading_time_sec double, error_distribution map<string, bigint>, "
    "family_breakdown map<string, struct<pass_rate: double, mean_score: double, n: bigint>>"
)
#: Rows of three kinds share one schema: training steps, evaluations and the final row.
TRAIN_LOG = (
    "epoch double, step bigint, loss double, grad_norm double, learning_rate double, eval_loss double, "
    "eval_runtime double, eval_samples_per_second double, eval_steps_per_second double, train_runtime double, "
    "train_samples_per_second double, train_steps_per_second double, total_flos double, train_loss double, "
    "entropy double, num_tokens double, mean_token_accuracy double, "
    + ", ".join(
        f"`{p}{n}` double"
        for p in ("", "eval_")
        for n in (
            "logits/chosen", "logits/rejected", "logps/chosen", "logps/rejected", "rewards/chosen",
            "rewards/rejected", "rewards/accuracies", "rewards/margins",
        )
    )
)
