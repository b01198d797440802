"""Movement and crowd-flow analytics as DataFrame transforms, for batch and Structured Streaming."""
