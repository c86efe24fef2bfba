"""Tables, snapshots and blobs in storage."""
