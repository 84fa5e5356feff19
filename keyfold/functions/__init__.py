"""Scalar functions: hashes that match the JVM's and the broker's, framing, headers and payloads."""
