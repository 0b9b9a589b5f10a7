"""The same semantics over Structured Streaming."""
