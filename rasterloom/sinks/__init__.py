"""Results: tables by Spark's writers, documents and single images for clients."""
