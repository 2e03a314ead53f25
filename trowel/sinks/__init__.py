"""Writing a survey: JSON, Mermaid, draw.io, a plain HTML map, a text summary, and the register of maps."""
