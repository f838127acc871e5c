"""Encoders: models that turn token ids into hidden states, attentions and logits."""
