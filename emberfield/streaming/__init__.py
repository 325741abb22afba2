"""The stateless part of the plans on a stream of incidents."""
