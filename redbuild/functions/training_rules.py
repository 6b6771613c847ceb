"""Templates and words the labelled training texts are made of."""

# --- fixed values: (error line, lines after it) per category -------------------
TEMPLATES = {
    "DEV_FAILURE": [
        ("error: compilation failed in module {module}", "make: *** [Makefile:{line}] Error 1"),
        ("fatal error: {header}.h: No such file or directory", "compilation terminated.\nbuild failed"),
        ("undefined reference to `{symbol}'", "collect2: error: ld returned 1 exit status"),
        ("clang: error: linker command failed with exit code 1", "ld: can't open output file for writing"),
        ("gcc: error: {file}.o: No such file or directory", "make: *** [all] Error 1"),
        ("syntax error near unexpected token `{token}'", "build failed"),
        ("undefined symbol: {symbol}", "linker error\nmingw32-make: *** [Makefile:{line}] Error 2"),
        ("gradle build failed", "FAILURE: Build failed with an exception.\nCompilation error"),
        ("maven build failed", "BUILD FAILURE\n[ERROR] compilation failed"),
        ("compilation terminated. fatal error: {header}.h not found", "make failed"),
        ("make: *** [{target}] Error {code}", "build failed due to compilation error"),
        ("preprocessor: error expanding macro {macro}", "compilation failed"),
        ("could not resolve dependency {module}", "dependency resolution failed"),
        ("ERROR: Could not find a version that satisfies the requirement {module}", "No matching distribution found"),
        ("npm ERR! 404 Not Found: {module}", "npm error: package not found"),
        ("Module not found: Error: Can't resolve '{module}'", "dependency missing"),
        ("Could not find artifact {module}:{file}", "dependency resolution failed\nunresolved dependency"),
        ("version conflict: {module} requires {file} but found {header}", "incompatible dependency"),
        ("Library not found for: -{module}", "linker error: missing dependency"),
        ("ERROR QUALITY GATE STATUS: FAILED", "quality gate failed\ncoverage is less than {pct}%"),
        ("quality gate status: failed", "new code coverage {pct}% is less than {pct2}%\nEXECUTION FAILURE"),
        ("failed quality gate", "coverage is less than required threshold\nquality gate condition failed"),
        ("quality gate failed: new code has {count} blocker issues", "quality gate status failed"),
        ("sonarscanner failed to connect to sonarqube server", "sonar authentication failed\nhttp 401"),
        ("linting failed: {count} errors found", "static analysis failed\nlint error"),
        ("pending identifications found in scan", "files pending for identification\nfail build on pending"),
    ],
    "TEST_FAILURE": [
        ("{count} tests failed", "junit: test execution failed\n{count} failures, {count2} errors"),
        ("assertion failed: expected {val} but was {val2}", "test execution failed"),
        ("pytest: {count} failed, {count2} passed", "FAILED {file}::test_{func}"),
        ("testng: {count} tests failed out of {count2}", "test suite failed"),
        ("java.lang.AssertionError: expected:<{val}> but was:<{val2}>", "junit test failure"),
        ("tests failed: {count} failures in {file}", "test execution failed\nassert {val} == {val2}"),
        ("test execution failed with exit code {code}", "{count} tests failed\n{count2} errors"),
        ("AssertionError: {count} != {count2}", "pytest test failure\ncollected {count} items"),
    ],
    "CI_INFRA_FAILURE": [
        ("WorkflowScript: {line}: unexpected token: {token}", "org.jenkinsci.plugins.workflow.cps.CpsCompilationErrorsException"),
        ("WorkflowScript: {line}: expecting '}}', found '{token}'", "groovy compilation error\npipeline failed"),
        ("No such DSL method '{func}' found among steps", "pipeline script error\nworkflow execution failed"),
        ("YAML syntax error: mapping values are not allowed here at line {line}", "workflow syntax error\ninvalid pipeline configuration"),
        ("Invalid workflow file: .github/workflows/{pipeline_file}", "workflow syntax error\npipeline failed"),
        ("Failed to parse pipeline script", "pipeline configuration invalid\nfailed to load workflow"),
        ("No stages defined in pipeline", "pipeline configuration invalid"),
        ("environment variable {var} is not set", "required configuration missing"),
        ("secret {var} not found", "credentials not configured"),
        ("token not set: {var}", "authentication failed\napi key missing"),
        ("ERROR: authentication failed — check {var}", "unauthorized: 401\ncredential not found"),
        ("configuration file not found: {file}.yml", "config error\nfailed to load settings"),
        ("permission denied accessing secret {var}", "http 403 forbidden\naccess rights missing"),
        ('No artifacts found that match the file pattern "{path}/*.{ext}". Configuration error?', "{path}/*.{ext} doesnt match anything\n0 artifacts archived"),
        ("0 artifacts archived", "no artifacts found that match file pattern"),
        ("failed to publish artifact to artifactory", "upload failed\nhttp 500"),
        ("docker push failed: http 500 internal server error", "registry upload failed"),
        ("maven deploy failed: could not transfer artifact", "upload failed"),
        ("docker build failed at step RUN {func}", "error response from daemon\nbuild failed"),
        ("pull access denied for {file}", "image not found\nmanifest unknown"),
        ("failed to pull image {file}:{code}", "cannot pull image\ndocker error"),
        ("container exited with non-zero code {code}", "docker run failed\noci runtime error"),
        ("cannot connect to the Docker daemon at unix:///var/run/docker.sock", "docker daemon error"),
        ("Dockerfile error at line {line}", "build failed\ninvalid Dockerfile instruction"),
        ("pod {file} is in CrashLoopBackOff", "back-off restarting failed container"),
        ("ImagePullBackOff for image {file}", "ErrImagePull\nfailed to pull image"),
        ("pod scheduling failed: insufficient memory", "unschedulable\nno nodes available"),
        ("OOMKilled: container {module} exceeded memory limit", "pod evicted\nresource exhausted"),
        ("kubectl error: deployment {module} failed", "rollout failed\ndeployment error"),
        ("ConfigMap {var} not found in namespace {module}", "configuration error\nkubectl error"),
        ("failed to mount volume {path}", "container failed to start\nkubernetes error"),
        ("connection refused: {host}:{port}", "network error\ncannot connect to service"),
        ("connection timed out: {host}:{port}", "socket timeout\nfailed to connect"),
        ("dns resolution failed for {host}", "name or service not known\nnetwork error"),
        ("no route to host: {host}", "host unreachable\nnetwork failure"),
        ("http 503 service unavailable from {host}", "network error\nserver unreachable"),
        ("out of memory: kill process {pid}", "OOM killer activated\nno space left on device"),
        ("no space left on device", "disk quota exceeded\nout of memory"),
        ("java.lang.OutOfMemoryError: Java heap space", "GC overhead limit exceeded"),
        ("cpu limit exceeded for container {module}", "resource constraints\nprocess throttled"),
        ("node is offline", "jenkins agent terminated\ncannot contact node"),
        ("executor lost: agent disconnected", "connection to agent lost\nchannel closed"),
        ("runner offline: {host}", "runner has stopped\ninfra failure"),
        ("[InfluxDB Plugin] Ignoring Exception", "infra warning\nobservability failure"),
    ],
}

# --- fixed values: words for each placeholder ------------------------------------
WORDS = {
    "module": ["core", "utils", "auth", "api", "sensor", "driver", "hal", "net"],
    "header": ["config", "types", "platform", "sensor_api", "bmi3x0", "hal"],
    "symbol": ["_init_sensor", "bmi3x0_init", "hal_read", "spi_transfer", "gpio_set"],
    "file": ["main", "sensor", "driver", "utils", "config", "api_handler"],
    "token": ["then", "do", "fi", "done", "{", "("],
    "target": ["all", "build", "test", "clean", "install"],
    "macro": ["SENSOR_ENABLE", "HAL_VERSION", "CONFIG_DEBUG", "PLATFORM_ID"],
    "func": ["test_init", "test_read", "test_config", "test_connection", "test_parse"],
    "val": ["true", "0", "null", "200", "SUCCESS", "1"],
    "val2": ["false", "1", "ERROR", "404", "FAIL", "0"],
    "pct": ["45", "62", "71", "38", "55", "80"],
    "pct2": ["80", "75", "90", "85", "70"],
    "count": ["3", "7", "12", "1", "5", "23"],
    "count2": ["1", "2", "4", "0"],
    "line": ["42", "108", "237", "15", "89"],
    "code": ["1", "2", "127", "255"],
    "path": ["linter_results", "unit-tests", "build/output", "dist", "reports"],
    "ext": ["lint", "zip", "json", "xml", "html", "log"],
    "host": ["sonarqube.internal", "fossid.company.com", "artifactory.corp"],
    "port": ["8080", "443", "9000", "8443"],
    "pid": ["1234", "5678", "9012"],
    "var": ["SONAR_AUTH_TOKEN", "FOSSID_API_KEY", "ARTIFACTORY_TOKEN", "KUBECONFIG", "DOCKER_TOKEN"],
    "pipeline_file": ["Jenkinsfile", "build.yml", "main.yml", "pipeline.groovy", "ci.yml"],
}

STAGE_OF = {"DEV_FAILURE": "build", "TEST_FAILURE": "unit_test", "CI_INFRA_FAILURE": "pipeline"}
SAMPLES_PER_TEMPLATE = 8
SEED = 42
