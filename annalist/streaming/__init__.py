from annalist.streaming.proofing import proof_stream

__all__ = ["proof_stream"]
