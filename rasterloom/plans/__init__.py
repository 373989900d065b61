"""Process graphs: JSON documents whose nodes name operators."""
