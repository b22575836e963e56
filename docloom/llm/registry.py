"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, fingerprint, htmltext, linededup, ngramjoin, secrets, sentencepieces, tokenfile, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_secrets": secrets.op2_secrets,
    "op3_htmltext": htmltext.op3_htmltext,
    "op4_sentencepiece": sentencepieces.op4_sentencepiece,
    "op5_ngramjoin": ngramjoin.op5_ngramjoin,
    "op6_chat": chat.op6_chat,
    "op7_tokenfile": tokenfile.op7_tokenfile,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_linededup": linededup.op9_linededup,
    "op10_fingerprint": fingerprint.op10_fingerprint,
}

ORACLE_SQL = {
    "op2_secrets": secrets.OP2_SQL,
    "op6_chat": chat.OP6_SQL,
}
