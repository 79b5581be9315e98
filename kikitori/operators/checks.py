"""Checks of settings and requests as named predicates over columns, so that one row or a table of them is judged alike."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: a synthesis request; ``clean_text`` is the normalized text, ``uses_caption`` and ``uses_speaker`` are what the model conditions on
REQUEST_RULES = {
    "seconds": "seconds IS NULL OR seconds > 0",
    "duration_scale": "duration_scale > 0",
    "min_seconds": "min_seconds > 0",
    "max_seconds": "max_seconds >= min_seconds",
    "num_candidates": "num_candidates > 0",
    "decode_mode": "lower(trim(decode_mode)) IN ('sequential', 'batch')",
    "text": "trim(clean_text) <> ''",
    "max_text_len": "max_text_len IS NULL OR max_text_len > 0",
    "max_caption_len": "NOT uses_caption OR max_caption_len IS NULL OR max_caption_len > 0",
    "truncation_factor": "truncation_factor IS NULL OR truncation_factor > 0",
    "rescale_pair": "(rescale_k IS NULL) = (rescale_sigma IS NULL)",
    "rescale_k": "rescale_k IS NULL OR rescale_k > 0",
    "rescale_sigma": "rescale_sigma IS NULL OR rescale_sigma > 0",
    "speaker_kv_scale": "speaker_kv_scale IS NULL OR NOT uses_speaker OR speaker_kv_scale > 0",
    "speaker_kv_min_t": "speaker_kv_scale IS NULL OR NOT uses_speaker OR coalesce(speaker_kv_min_t, 0.9) BETWEEN 0 AND 1",
    "speaker_kv_max_layers": "speaker_kv_scale IS NULL OR NOT uses_speaker OR coalesce(speaker_kv_max_layers, 0) >= 0",
    "cfg_guidance_mode": "lower(trim(cfg_guidance_mode)) IN ('independent', 'joint', 'alternating')",
}

#: training settings, the model's among them
SETTINGS_RULES = {
    "inversion_speaker": "NOT speaker_inversion_enabled OR use_speaker_condition",
    "inversion_init": "NOT speaker_inversion_enabled OR init_checkpoint IS NOT NULL",
    "inversion_resume": "NOT speaker_inversion_enabled OR resume IS NULL",
    "inversion_lora": "NOT speaker_inversion_enabled OR NOT lora_enabled",
    "inversion_mode": "NOT speaker_inversion_enabled OR train_mode = 'rf'",
    "inversion_warmup": "NOT speaker_inversion_enabled OR NOT caption_warmup",
    "speaker_inversion_tokens": "NOT speaker_inversion_enabled OR speaker_inversion_tokens > 0",
    "speaker_inversion_init_std": "NOT speaker_inversion_enabled OR speaker_inversion_init_std >= 0",
    "caption_condition_dropout": "caption_condition_dropout BETWEEN 0 AND 1",
    "fixed_target_latent_steps": "fixed_target_latent_steps IS NULL OR fixed_target_latent_steps > 0",
    "fixed_target_full_mask": "NOT fixed_target_full_mask OR fixed_target_latent_steps IS NOT NULL",
    "rf_loss_mode": "lower(trim(rf_loss_mode)) IN ('echo', 'utterance_mean')",
    "duration_loss_weight": "duration_loss_weight >= 0",
    "duration_speaker_dropout": "duration_speaker_dropout BETWEEN 0 AND 1",
    "duration_caption_dropout": "duration_caption_dropout BETWEEN 0 AND 1",
    "duration_huber_delta": "duration_huber_delta > 0",
    "duration_only_predictor": "train_mode <> 'duration_only' OR use_duration_predictor",
    "duration_only_lora": "train_mode <> 'duration_only' OR NOT lora_enabled",
    "duration_only_warmup": "train_mode <> 'duration_only' OR NOT caption_warmup",
    "duration_aux_dim": "NOT use_duration_predictor OR duration_aux_dim > 0",
    "duration_hidden_dim": "NOT use_duration_predictor OR duration_hidden_dim > 0",
    "duration_layers": "NOT use_duration_predictor OR duration_layers > 0",
    "duration_dropout": "NOT use_duration_predictor OR duration_dropout BETWEEN 0 AND 1",
    "duration_attention_heads": "NOT use_duration_predictor OR duration_attention_heads > 0",
    "duration_heads_divide": "NOT use_duration_predictor OR text_dim % duration_attention_heads = 0",
    "duration_token_init_frames": "NOT use_duration_predictor OR duration_token_init_frames > 0",
    "caption_warmup_steps": "caption_warmup_steps >= 0",
    "dataloader_prefetch_factor": "dataloader_prefetch_factor > 0",
    "valid_ratio": "valid_ratio >= 0 AND valid_ratio < 1",
    "valid_every": "valid_every >= 0",
    "valid_every_needed": "valid_ratio = 0 OR valid_every > 0",
    "checkpoint_best_n": "checkpoint_best_n >= 0",
    "lora_dropout": "NOT lora_enabled OR lora_dropout BETWEEN 0 AND 1",
    "lora_r": "NOT lora_enabled OR lora_r > 0",
    "lora_alpha": "NOT lora_enabled OR lora_alpha > 0",
    "resume_and_init": "resume IS NULL OR init_checkpoint IS NULL OR lora_enabled",
    "lora_base": "NOT lora_enabled OR resume IS NOT NULL OR init_checkpoint IS NOT NULL",
}


def broken(rules: Mapping[str, str]) -> Column:
    """Names of the rules a row breaks, in order; a rule that can't be told (a null where a value is needed) is broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def first_broken(rules: Mapping[str, str]) -> Column:
    """The first rule a row breaks; null for rows that keep all."""
    found = F.lit(None).cast("string")
    for name, rule in reversed(rules.items()):
        found = F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)).otherwise(found)
    return found


def first_broken_sql(rules: Mapping[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({rule}, false) THEN '{name}'" for name, rule in rules.items()) + " END"
