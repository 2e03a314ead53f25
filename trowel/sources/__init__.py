"""Reading source trees, commit logs and packaging metadata into fact tables. Nothing read is ever executed."""
