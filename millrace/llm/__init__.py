"""Operators for training data: near duplicates, packing, token files, decontamination, sharding, quality, chat
formatting, toxicity, language-model scores and repeated passages. Nothing outside this package imports it."""
