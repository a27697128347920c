"""Tables, JSON documents and the HTTP source."""
