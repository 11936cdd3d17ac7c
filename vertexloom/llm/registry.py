"""Queries of this package by name, and their SQL."""

from __future__ import annotations

from vertexloom.llm import chat, decontaminate, linededup, mixing, neighbours, pii, quality, simhash, toxicity, warc

QUERIES = {"op1_simhash": simhash.op1_simhash, "op2_chat": chat.op2_chat, "op3_quality": quality.op3_quality, "op4_warc": warc.op4_warc, "op5_mixing": mixing.op5_mixing, "op6_neighbours": neighbours.op6_neighbours, "op7_linededup": linededup.op7_linededup, "op8_toxicity": toxicity.op8_toxicity, "op9_decontaminate": decontaminate.op9_decontaminate, "op10_pii": pii.op10_pii}
ORACLE = {"op2_chat": chat.SQL, "op4_warc": warc.SQL, "op5_mixing": mixing.SQL}
