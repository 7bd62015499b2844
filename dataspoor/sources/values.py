"""Fixed values of the rule catalogue: patterns of public libraries' APIs, in order.

Patterns are globs of API paths, several in one text with spaces between. A
language is the first part of an id: js, py or cs. These values decide what a scan
finds, so they are stated as they are and not derived.
"""

from __future__ import annotations

# Fixed values: (id, class, processor, calls).
SINKS = (
    ("js.console", "log", None, "console.{log,info,warn,error,debug,trace,dir,table,group,groupCollapsed,assert}"),
    ("js.pino", "log", None, "pino:**.{trace,debug,info,warn,error,fatal}"),
    ("js.winston", "log", None, "winston:**.{log,info,warn,error,debug,verbose,silly,http}"),
    ("js.bunyan", "log", None, "bunyan:**.{trace,debug,info,warn,error,fatal}"),
    ("js.loglevel", "log", None, "loglevel:**.{trace,debug,info,warn,error}"),
    ("js.nestjs.logger", "log", None, "@nestjs/common:Logger**.{log,error,warn,debug,verbose,fatal}"),
    ("js.logger-by-name", "log", None, ""),
    ("js.sentry", "error_tracking", "Sentry", "@sentry/*:{setUser,setContext,setExtra,setExtras,setTag,setTags,addBreadcrumb,captureException,captureMessage,captureEvent} @sentry/*:**.{setUser,setContext,setExtra,setExtras,setTag,setTags,addBreadcrumb,captureException,captureMessage,captureEvent}"),
    ("js.segment", "analytics", "Segment", "{@segment/analytics-node,analytics-node,@segment/analytics-next}:**.{identify,track,page,screen,group,alias}"),
    ("js.mixpanel", "analytics", "Mixpanel", "{mixpanel,mixpanel-browser}:**.{track,identify,alias,register,register_once,track_with_groups} {mixpanel,mixpanel-browser}:**.people.{set,set_once,append,union,increment}"),
    ("js.posthog", "analytics", "PostHog", "{posthog-node,posthog-js}:**.{capture,identify,alias,groupIdentify,register,setPersonProperties,group}"),
    ("js.amplitude", "analytics", "Amplitude", "{@amplitude/analytics-node,@amplitude/analytics-browser,amplitude-js}:**.{track,logEvent,identify,setUserId,setGroup}"),
    ("js.sendgrid", "messaging", "SendGrid", "@sendgrid/mail:**.{send,sendMultiple}"),
    ("js.postmark", "messaging", "Postmark", "postmark:**.{sendEmail,sendEmailWithTemplate,sendEmailBatch,sendEmailBatchWithTemplates}"),
    ("js.twilio", "messaging", "Twilio", "twilio:**.{messages,calls}.create twilio:**.verifications.create"),
    ("js.nodemailer", "messaging", None, "{nodemailer,@tryghost/nodemailer}:**.sendMail"),
    ("js.nestjs-mailer", "messaging", None, "@nestjs-modules/mailer:MailerService{,()}.sendMail"),
    ("js.wasp-email", "messaging", None, "wasp/server/email:emailSender.send"),
    ("js.resend", "messaging", "Resend", "resend:**.emails.{send,create} resend:**.batch.send"),
    ("js.mailgun", "messaging", "Mailgun", "mailgun.js:**.messages.create"),
    ("js.aws-ses", "messaging", "Amazon SES", "{@aws-sdk/client-ses,@aws-sdk/client-sesv2}:**.send"),
    ("js.aws-sns", "messaging", "Amazon SNS", "@aws-sdk/client-sns:**.send"),
    ("js.mailersend", "messaging", "MailerSend", "mailersend:MailerSend{,()}.{email,sms}.send"),
    ("js.mailchimp-transactional", "messaging", "Mailchimp Transactional", "@mailchimp/mailchimp_transactional:**.messages.{send,sendTemplate}"),
    ("js.brevo", "messaging", "Brevo", "{@getbrevo/brevo,sib-api-v3-sdk}:**.{sendTransacEmail,sendTransacSms}"),
    ("js.mailjet", "messaging", "Mailjet", "node-mailjet:**.post().request"),
    ("js.vonage", "messaging", "Vonage", "@vonage/server-sdk:Vonage{,()}.{sms,messages}.send"),
    ("js.telegram", "messaging", "Telegram", "node-telegram-bot-api:**.{sendMessage,sendPhoto,sendDocument,sendContact,sendLocation} telegraf:**.telegram.{sendMessage,sendPhoto,sendDocument,sendContact,sendLocation}"),
    ("js.firebase-messaging", "messaging", "Firebase Cloud Messaging", "firebase-admin:**.messaging().{send,sendEach,sendEachForMulticast,sendMulticast,sendAll,sendToDevice,sendToTopic} firebase-admin/messaging:getMessaging().{send,sendEach,sendEachForMulticast,sendMulticast,sendAll}"),
    ("js.expo-push", "messaging", "Expo", "expo-server-sdk:Expo{,()}.sendPushNotificationsAsync"),
    ("js.web-push", "messaging", None, "web-push:{sendNotification,default.sendNotification}"),
    ("js.novu", "messaging", "Novu", "{@novu/node,@novu/api}:Novu{,()}.trigger"),
    ("js.knock", "messaging", "Knock", "@knocklabs/node:Knock{,()}.workflows.trigger"),
    ("js.customerio", "messaging", "Customer.io", "customerio-node:{TrackClient,APIClient}{,()}.{identify,track,trackAnonymous,sendEmail,sendPush}"),
    ("js.loops", "messaging", "Loops", "loops:LoopsClient{,()}.{sendTransactionalEmail,createContact,updateContact,sendEvent}"),
    ("js.openai", "llm", "OpenAI", "openai:**.{chat.completions.create,chat.completions.parse,chat.completions.stream,completions.create,responses.create,responses.stream,embeddings.create,moderations.create} openai:**.beta.{chat.completions.parse,chat.completions.stream,threads.messages.create,threads.runs.create}"),
    ("js.anthropic", "llm", "Anthropic", "@anthropic-ai/sdk:**.messages.{create,stream,countTokens} @anthropic-ai/sdk:**.completions.create"),
    ("js.gemini", "llm", "Google", "@google/generative-ai:**.{generateContent,generateContentStream,sendMessage,sendMessageStream,embedContent,countTokens} @google/genai:**.models.{generateContent,generateContentStream,embedContent,countTokens} @google/genai:**.{sendMessage,sendMessageStream}"),
    ("js.mistral", "llm", "Mistral", "@mistralai/mistralai:**.{chat.complete,chat.stream,embeddings.create,fim.complete,agents.complete}"),
    ("js.langchain.openai", "llm", "OpenAI", "@langchain/openai:**.{invoke,stream,batch,call,predict,generate,embedQuery,embedDocuments}"),
    ("js.langchain.anthropic", "llm", "Anthropic", "@langchain/anthropic:**.{invoke,stream,batch,call,predict,generate}"),
    ("js.langchain.google", "llm", "Google", "@langchain/google-genai:**.{invoke,stream,batch,call,predict,generate,embedQuery,embedDocuments}"),
    ("js.langchain.mistral", "llm", "Mistral", "@langchain/mistralai:**.{invoke,stream,batch,call,predict,generate,embedQuery,embedDocuments}"),
    ("js.vercel-ai", "llm", None, "ai:{generateText,streamText,generateObject,streamObject,embed,embedMany}"),
    ("js.stripe", "third_party", "Stripe", "stripe:**.{customers,checkout.sessions,billingPortal.sessions,paymentIntents,subscriptions,invoices,setupIntents,paymentLinks}.{create,update}"),
    ("js.polar", "third_party", "Polar", "@polar-sh/sdk:Polar{,()}.**.{create,update}"),
    ("js.aws-s3", "third_party", "Amazon S3", "@aws-sdk/client-s3:**.send @aws-sdk/lib-storage:Upload()"),
    ("js.azure-blob", "third_party", "Azure Storage", "@azure/storage-blob:**.{upload,uploadData,uploadStream,uploadFile}"),
    ("js.gcs", "third_party", "Google Cloud Storage", "@google-cloud/storage:**.{save,upload,createWriteStream}"),
    ("js.algolia", "third_party", "Algolia", "{algoliasearch,algoliasearch/lite}:**.{saveObject,saveObjects,partialUpdateObject,partialUpdateObjects,addOrUpdateObject}"),
    ("js.intercom", "third_party", "Intercom", "intercom-client:**.{contacts,events,conversations,messages}.{create,update,reply}"),
    ("js.hubspot", "third_party", "HubSpot", "@hubspot/api-client:**.{create,update,upsert,batchApi.create}"),
    ("js.slack", "messaging", "Slack", "@slack/web-api:**.chat.{postMessage,postEphemeral,update} @slack/webhook:IncomingWebhook{,()}.send"),
    ("js.inngest", "third_party", "Inngest", "inngest:**.send"),
    ("js.trigger-dev", "third_party", "Trigger.dev", "@trigger.dev/sdk{,/v3}:**.{trigger,batchTrigger,triggerAndWait}"),
    ("js.fetch", "http", None, "fetch {node-fetch,cross-fetch,isomorphic-fetch}: undici:{fetch,request}"),
    ("js.axios", "http", None, "axios: axios:{get,post,put,patch,delete,request,head,options,postForm,putForm}"),
    ("js.axios.instance", "http", None, "axios:create() axios:{create(),AxiosInstance}.{get,post,put,patch,delete,request,head,options,postForm,putForm}"),
    ("js.got-ky", "http", None, "{got,ky}: {got,ky}:{get,post,put,patch,delete,head}"),
    ("js.web-storage", "browser_storage", None, "{localStorage,sessionStorage}.setItem"),
    ("js.js-cookie", "browser_storage", None, "js-cookie:{set,default.set} js-cookie:set"),
    ("py.print", "log", None, "builtins.print"),
    ("py.logging", "log", None, "logging.{debug,info,warning,warn,error,exception,critical,fatal,log} logging.**.{debug,info,warning,warn,error,exception,critical,fatal,log}"),
    ("py.structlog", "log", None, "structlog.**.{debug,info,warning,warn,error,exception,critical,fatal,msg,log,bind}"),
    ("py.loguru", "log", None, "loguru.logger.** loguru.logger.{trace,debug,info,success,warning,error,critical,exception,log}"),
    ("py.logger-by-name", "log", None, ""),
    ("py.sentry", "error_tracking", "Sentry", "sentry_sdk.{set_user,set_context,set_extra,set_tag,set_tags,add_breadcrumb,capture_message,capture_exception,capture_event} sentry_sdk.**.{set_user,set_context,set_extra,set_tag,set_tags,add_breadcrumb,capture_message,capture_exception,capture_event}"),
    ("py.segment", "analytics", "Segment", "segment.analytics.**{identify,track,page,screen,group,alias} analytics.{identify,track,page,screen,group,alias}"),
    ("py.mixpanel", "analytics", "Mixpanel", "mixpanel.Mixpanel{,()}.{track,alias,people_set,people_set_once,people_append,people_union,people_increment,import_data,group_set}"),
    ("py.posthog", "analytics", "PostHog", "posthog.{capture,identify,alias,set,set_once,group_identify} posthog.{Posthog,Client}{,()}.{capture,identify,alias,set,set_once,group_identify}"),
    ("py.amplitude", "analytics", "Amplitude", "amplitude.Amplitude{,()}.{track,identify,set_group}"),
    ("py.sendgrid", "messaging", "SendGrid", "sendgrid.SendGridAPIClient{,()}.send sendgrid.SendGridAPIClient{,()}.client.mail.send.post"),
    ("py.postmark", "messaging", "Postmark", "postmarker.core.PostmarkClient{,()}.emails.{send,send_with_template,send_batch}"),
    ("py.twilio", "messaging", "Twilio", "twilio.rest.Client{,()}.{messages,calls}.create twilio.rest.Client{,()}.**.verifications.create"),
    ("py.django.mail", "messaging", None, "django.core.mail.{send_mail,send_mass_mail,mail_admins,mail_managers} django.core.mail.{EmailMessage,EmailMultiAlternatives}{,()}.send"),
    ("py.smtplib", "messaging", None, "smtplib.{SMTP,SMTP_SSL,LMTP}{,()}.{sendmail,send_message}"),
    ("py.flask-mail", "messaging", None, "flask_mail.{Mail,Connection}{,()}.{send,send_message} flask_mail.Mail{,()}.connect{,()}.{send,send_message} flask_mail.Message{,()}.send"),
    ("py.fastapi-mail", "messaging", None, "fastapi_mail.FastMail{,()}.send_message"),
    ("py.emails", "messaging", None, "emails.{Message,html,message.Message,message.html}{,()}.send"),
    ("py.apprise", "messaging", None, "apprise.Apprise{,()}.{notify,async_notify}"),
    ("py.resend", "messaging", "Resend", "resend.{Emails,Batch}.send"),
    ("py.mailjet", "messaging", "Mailjet", "mailjet_rest.Client{,()}.send.create"),
    ("py.brevo", "messaging", "Brevo", "{sib_api_v3_sdk,brevo_python}.{TransactionalEmailsApi,TransactionalSMSApi}{,()}.{send_transac_email,send_transac_sms}"),
    ("py.mailchimp-transactional", "messaging", "Mailchimp Transactional", "mailchimp_transactional.Client{,()}.messages.{send,send_template}"),
    ("py.vonage", "messaging", "Vonage", "vonage.{Client,Vonage}{,()}.{sms,messages}.{send,send_message}"),
    ("py.telegram", "messaging", "Telegram", "telegram.Bot{,()}.{send_message,send_photo,send_document,send_contact,send_location}"),
    ("py.boto3-sns", "messaging", "Amazon SNS", "boto3.client{,()}.{publish,publish_batch}"),
    ("py.firebase-messaging", "messaging", "Firebase Cloud Messaging", "firebase_admin.messaging.{send,send_each,send_each_for_multicast,send_multicast,send_all}"),
    ("py.expo-push", "messaging", "Expo", "exponent_server_sdk.PushClient{,()}.{publish,publish_multiple}"),
    ("py.webpush", "messaging", None, "pywebpush.webpush pywebpush.WebPusher{,()}.send"),
    ("py.openai", "llm", "OpenAI", "openai.**.{chat.completions.create,chat.completions.parse,completions.create,responses.create,embeddings.create,moderations.create} openai.**.beta.{chat.completions.parse,threads.messages.create,threads.runs.create} openai.{ChatCompletion,Completion,Embedding}.create"),
    ("py.anthropic", "llm", "Anthropic", "anthropic.**.messages.{create,stream,count_tokens} anthropic.**.completions.create"),
    ("py.gemini", "llm", "Google", "google.generativeai.GenerativeModel{,()}.{generate_content,count_tokens} google.generativeai.GenerativeModel{,()}.start_chat{,()}.send_message google.generativeai.embed_content google.genai.Client{,()}.**.{generate_content,generate_content_stream,embed_content,send_message,send_message_stream}"),
    ("py.mistral", "llm", "Mistral", "mistralai.**.{chat.complete,chat.stream,embeddings.create,fim.complete,agents.complete} mistralai.client.MistralClient{,()}.{chat,chat_stream}"),
    ("py.langchain.openai", "llm", "OpenAI", "langchain_openai.{ChatOpenAI,OpenAI,AzureChatOpenAI,OpenAIEmbeddings}{,()}.{invoke,ainvoke,stream,astream,batch,abatch,predict,generate,embed_query,embed_documents}"),
    ("py.langchain.anthropic", "llm", "Anthropic", "langchain_anthropic.ChatAnthropic{,()}.{invoke,ainvoke,stream,astream,batch,abatch,predict,generate}"),
    ("py.langchain.google", "llm", "Google", "langchain_google_genai.{ChatGoogleGenerativeAI,GoogleGenerativeAIEmbeddings}{,()}.{invoke,ainvoke,stream,astream,batch,abatch,embed_query,embed_documents}"),
    ("py.langchain.mistral", "llm", "Mistral", "langchain_mistralai.{ChatMistralAI,MistralAIEmbeddings}{,()}.{invoke,ainvoke,stream,astream,batch,abatch,embed_query,embed_documents}"),
    ("py.stripe", "third_party", "Stripe", "stripe.{Customer,checkout.Session,billing_portal.Session,PaymentIntent,Subscription,Invoice,SetupIntent}.{create,modify} stripe.StripeClient{,()}.**.{create,update}"),
    ("py.polar", "third_party", "Polar", "polar_sdk.Polar{,()}.**.{create,update}"),
    ("py.boto3-s3", "third_party", "Amazon S3", "boto3.client{,()}.{put_object,upload_file,upload_fileobj} boto3.resource{,()}.**.{put,upload_file,upload_fileobj}"),
    ("py.boto3-ses", "messaging", "Amazon SES", "boto3.client{,()}.{send_email,send_raw_email,send_templated_email}"),
    ("py.slack", "messaging", "Slack", "slack_sdk.**.WebClient{,()}.chat_{postMessage,postEphemeral,update,scheduleMessage} slack_sdk.**.WebhookClient{,()}.send"),
    ("py.gcs", "third_party", "Google Cloud Storage", "google.cloud.storage.**.upload_from_{string,filename,file}"),
    ("py.requests", "http", None, "requests.{get,post,put,patch,delete,head,options} requests.Session{,()}.{get,post,put,patch,delete,head,options}"),
    ("py.requests.request", "http", None, "requests.request requests.Session{,()}.request"),
    ("py.httpx", "http", None, "httpx.{get,post,put,patch,delete,head,options,stream}"),
    ("py.httpx.client", "http", None, "httpx.{Client,AsyncClient}{,()}.{get,post,put,patch,delete,head,options,stream}"),
    ("py.aiohttp", "http", None, "aiohttp.ClientSession{,()}.{get,post,put,patch,delete,head,options,request}"),
    ("py.urllib", "http", None, "urllib.request.urlopen"),
    ("cs.microsoft-logging", "log", None, "Microsoft.Extensions.Logging.{ILogger,ILoggerFactory,Logger,LoggerFactory}**.{Log,LogTrace,LogDebug,LogInformation,LogWarning,LogError,LogCritical,BeginScope}"),
    ("cs.logger-message", "log", None, ""),
    ("cs.console", "log", None, "System.Console.{Write,WriteLine} System.Console.{Out,Error}.{Write,WriteLine,WriteAsync,WriteLineAsync}"),
    ("cs.diagnostics", "log", None, "System.Diagnostics.{Debug,Trace}.{Write,WriteLine,WriteIf,WriteLineIf,Print,Fail,TraceInformation,TraceWarning,TraceError}"),
    ("cs.serilog", "log", None, "Serilog.{Log,ILogger,Core.Logger}{,()}**.{Write,Verbose,Debug,Information,Warning,Error,Fatal} Serilog.Context.LogContext.PushProperty"),
    ("cs.nlog", "log", None, "NLog.{Logger,ILogger,LogManager}{,()}**.{Trace,Debug,Info,Warn,Error,Fatal,Log}"),
    ("cs.log4net", "log", None, "log4net.{ILog,LogManager}{,()}**.{Debug,Info,Warn,Error,Fatal,DebugFormat,InfoFormat,WarnFormat,ErrorFormat,FatalFormat}"),
    ("cs.activity-tags", "log", None, "System.Diagnostics.Activity{,()}**.{SetTag,AddTag,AddEvent,SetBaggage,AddBaggage}"),
    ("cs.duende-events", "log", None, "Duende.IdentityServer.Services.{IEventService,DefaultEventService}{,()}.RaiseAsync"),
    ("cs.logger-by-name", "log", None, ""),
    ("cs.httpclient", "http", None, "System.Net.Http.{HttpClient,HttpMessageInvoker,IHttpClientFactory}{,()}**.{GetAsync,GetStringAsync,GetByteArrayAsync,GetStreamAsync,GetFromJsonAsync,GetFromJsonAsAsyncEnumerable,PostAsync,PostAsJsonAsync,PutAsync,PutAsJsonAsync,PatchAsync,PatchAsJsonAsync,DeleteAsync,DeleteFromJsonAsync}"),
    ("cs.httpclient.send", "http", None, "System.Net.Http.{HttpClient,HttpMessageInvoker,IHttpClientFactory}{,()}**.{SendAsync,Send}"),
    ("cs.restsharp", "http", None, "RestSharp.{RestClient,IRestClient}{,()}**.{Execute,ExecuteAsync,ExecuteGetAsync,ExecutePostAsync,ExecutePutAsync,PostAsync,PutAsync,PatchAsync,GetAsync,DeleteAsync,PostJsonAsync,PutJsonAsync}"),
    ("cs.refit", "http", None, ""),
    ("cs.maui.secure-storage", "device_storage", None, "{Microsoft.Maui.Storage.,Xamarin.Essentials.,}SecureStorage{,.Default}.SetAsync Microsoft.Maui.Storage.ISecureStorage.SetAsync"),
    ("cs.maui.preferences", "device_storage", None, "{Microsoft.Maui.Storage.,Xamarin.Essentials.,}Preferences{,.Default}.Set Microsoft.Maui.Storage.IPreferences.Set"),
    ("cs.sentry", "error_tracking", "Sentry", "Sentry.SentrySdk.{CaptureException,CaptureMessage,CaptureEvent,CaptureFeedback,CaptureUserFeedback,AddBreadcrumb,SetTag,SetExtra,SetUser} Sentry.SentrySdk.{ConfigureScope,ConfigureScopeAsync}.<cb0>.{SetTag,SetTags,SetExtra,SetExtras,AddBreadcrumb,SetUser} Sentry.{IHub,Hub,Scope,ISentryClient,SentryClient}{,()}**.{CaptureException,CaptureMessage,CaptureEvent,AddBreadcrumb,SetTag,SetTags,SetExtra,SetExtras}"),
    ("cs.application-insights", "error_tracking", "Azure Application Insights", "Microsoft.ApplicationInsights.TelemetryClient{,()}**.{TrackEvent,TrackTrace,TrackException,TrackMetric,TrackDependency,TrackRequest,TrackPageView,TrackAvailability,Track}"),
    ("cs.segment", "analytics", "Segment", "Segment.{Analytics,Client,IAnalyticsClient}{,()}**.{Identify,Track,Page,Screen,Group,Alias}"),
    ("cs.mixpanel", "analytics", "Mixpanel", "Mixpanel.{MixpanelClient,IMixpanelClient}{,()}**.{Track,TrackAsync,Alias,AliasAsync,PeopleSet,PeopleSetAsync,PeopleSetOnce,PeopleSetOnceAsync,PeopleAppend,PeopleAppendAsync,PeopleUnion,PeopleUnionAsync,Send,SendAsync}"),
    ("cs.posthog", "analytics", "PostHog", "PostHog.{PostHogClient,IPostHogClient}{,()}**.{Capture,CaptureEvent,Identify,IdentifyAsync,Alias,AliasAsync,GroupIdentify,GroupIdentifyAsync}"),
    ("cs.rabbitmq", "messaging", None, "RabbitMQ.Client.{IModel,IChannel,IConnection,ConnectionFactory,IConnectionFactory,Model,Channel}{,()}**.{BasicPublish,BasicPublishAsync}"),
    ("cs.masstransit", "messaging", None, "MassTransit.{IBus,IPublishEndpoint,ISendEndpoint,ISendEndpointProvider,IBusControl,ConsumeContext}{,()}**.{Publish,Send,PublishBatch,SendBatch,RespondAsync}"),
    ("cs.azure-service-bus", "messaging", "Azure Service Bus", "Azure.Messaging.ServiceBus.{ServiceBusSender,ServiceBusClient}{,()}**.{SendMessageAsync,SendMessagesAsync,ScheduleMessageAsync,ScheduleMessagesAsync}"),
    ("cs.azure-event-hubs", "messaging", "Azure Event Hubs", "Azure.Messaging.EventHubs.{Producer.EventHubProducerClient,Producer.EventHubBufferedProducerClient}{,()}**.{SendAsync,EnqueueEventAsync,EnqueueEventsAsync}"),
    ("cs.azure-queues", "messaging", "Azure Storage", "Azure.Storage.Queues.QueueClient{,()}**.{SendMessage,SendMessageAsync,UpdateMessage,UpdateMessageAsync}"),
    ("cs.kafka", "messaging", None, "Confluent.Kafka.{IProducer,Producer}{,()}**.{Produce,ProduceAsync}"),
    ("cs.aws-sns", "messaging", "Amazon SNS", "Amazon.SimpleNotificationService.{IAmazonSimpleNotificationService,AmazonSimpleNotificationServiceClient}{,()}**.{PublishAsync,PublishBatchAsync}"),
    ("cs.aws-sqs", "messaging", "Amazon SQS", "Amazon.SQS.{IAmazonSQS,AmazonSQSClient}{,()}**.{SendMessageAsync,SendMessageBatchAsync}"),
    ("cs.aws-ses", "messaging", "Amazon SES", "Amazon.SimpleEmail.{IAmazonSimpleEmailService,AmazonSimpleEmailServiceClient}{,()}**.{SendEmailAsync,SendRawEmailAsync,SendTemplatedEmailAsync,SendBulkTemplatedEmailAsync} Amazon.SimpleEmailV2.{IAmazonSimpleEmailServiceV2,AmazonSimpleEmailServiceV2Client}{,()}**.{SendEmailAsync,SendBulkEmailAsync}"),
    ("cs.sendgrid", "messaging", "SendGrid", "SendGrid.{ISendGridClient,SendGridClient,BaseClient}{,()}**.{SendEmailAsync,RequestAsync}"),
    ("cs.mailkit", "messaging", None, "MailKit.{Net.Smtp.SmtpClient,Net.Smtp.ISmtpClient,IMailTransport,MailTransport}{,()}**.{Send,SendAsync}"),
    ("cs.smtpclient", "messaging", None, "System.Net.Mail.SmtpClient{,()}**.{Send,SendAsync,SendMailAsync}"),
    ("cs.twilio", "messaging", "Twilio", "Twilio.Rest.**.{MessageResource,CallResource,VerificationResource}.{Create,CreateAsync}"),
    ("cs.microsoft-extensions-ai", "llm", None, "Microsoft.Extensions.AI.{IChatClient,DelegatingChatClient,IEmbeddingGenerator,DelegatingEmbeddingGenerator}{,()}**.{GetResponseAsync,GetStreamingResponseAsync,GetResponse,CompleteAsync,CompleteStreamingAsync,GenerateAsync,GenerateVectorAsync,GenerateEmbeddingAsync,GenerateEmbeddingVectorAsync} **.{AsIChatClient,AsChatClient,AsIEmbeddingGenerator,AsEmbeddingGenerator}().**.{GetResponseAsync,GetStreamingResponseAsync,GenerateAsync,GenerateVectorAsync,GenerateEmbeddingVectorAsync}"),
    ("cs.openai", "llm", "OpenAI", "OpenAI.{OpenAIClient,Chat.ChatClient,Embeddings.EmbeddingClient,Responses.OpenAIResponseClient,Assistants.AssistantClient,Audio.AudioClient,Moderations.ModerationClient}{,()}**.{CompleteChat,CompleteChatAsync,CompleteChatStreaming,CompleteChatStreamingAsync,GenerateEmbedding,GenerateEmbeddingAsync,GenerateEmbeddings,GenerateEmbeddingsAsync,CreateResponse,CreateResponseAsync,CreateResponseStreamingAsync,CreateMessage,CreateMessageAsync,ClassifyText,ClassifyTextAsync}"),
    ("cs.azure-openai", "llm", "Azure OpenAI", "Azure.AI.OpenAI.{AzureOpenAIClient,OpenAIClient}{,()}**.{CompleteChat,CompleteChatAsync,CompleteChatStreaming,CompleteChatStreamingAsync,GenerateEmbedding,GenerateEmbeddingAsync,GetChatCompletions,GetChatCompletionsAsync,GetChatCompletionsStreamingAsync,GetCompletionsAsync,GetEmbeddingsAsync}"),
    ("cs.anthropic", "llm", "Anthropic", "Anthropic.{AnthropicClient,IAnthropicClient}{,()}**.Messages.{Create,CreateStreaming,CountTokens} Anthropic.{AnthropicClient,IAnthropicClient}{,()}**.Messages.Batches.Create Anthropic.SDK.AnthropicClient{,()}**.{GetClaudeMessageAsync,StreamClaudeMessageAsync}"),
)
# Sinks by the receiver's name, (id, receivers, methods).
SINK_RECEIVERS = (
    ("js.logger-by-name", "logger log LOGGER _logger appLogger", "log info warn error debug trace fatal verbose"),
    ("py.logger-by-name", "logger log LOGGER _logger _log", "debug info warning warn error exception critical fatal log"),
    ("cs.logger-by-name", "logger _logger log _log Logger Log", "LogTrace LogDebug LogInformation LogWarning LogError LogCritical Log Information Warning Error Debug Fatal Info Warn Verbose"),
)
# Properties whose writes are sinks, (id, paths).
SINK_ASSIGNS = (
    ("js.web-storage", "document.cookie"),
    ("cs.sentry", "Sentry.**.User Sentry.**.User.{Email,Username,IpAddress,Id}"),
    ("cs.application-insights", "Microsoft.ApplicationInsights.TelemetryClient{,()}.Context.User.{Id,AuthenticatedUserId,AccountId}"),
)
# Decorators of functions whose calls are sinks, (id, paths).
SINK_DECORATORS = (
    ("cs.logger-message", "Microsoft.Extensions.Logging.LoggerMessageAttribute{,()}"),
    ("cs.refit", "Refit.{GetAttribute,PostAttribute,PutAttribute,PatchAttribute,DeleteAttribute,HeadAttribute}{,()}"),
)
# Sinks that take some arguments only, (id, positions).
SINK_ARGUMENTS = (
    ("cs.maui.secure-storage", (1,)),
    ("cs.maui.preferences", (1,)),
)
# Sinks that the receiver's data leaves by as well, (id,).
SINK_RECEIVER_DATA = (
    ("py.django.mail",),
    ("py.flask-mail",),
    ("py.emails",),
    ("py.apprise",),
)
# Where an outbound call says its URL, (id, position, keyword, field, relative to a base address).
SINK_HOSTS = (
    ("js.fetch", 0, None, None, False),
    ("js.axios", 0, None, "url", False),
    ("js.axios.instance", 0, None, "url", True),
    ("js.got-ky", 0, None, None, False),
    ("py.requests", 0, "url", None, False),
    ("py.requests.request", 1, "url", None, False),
    ("py.httpx", 0, "url", None, False),
    ("py.httpx.client", 0, "url", None, True),
    ("py.aiohttp", 0, "url", None, True),
    ("py.urllib", 0, "url", None, False),
    ("cs.httpclient", 0, None, None, True),
    ("cs.httpclient.send", 0, None, "RequestUri", True),
    ("cs.restsharp", 0, None, None, True),
)
# Fixed values: (id, flow, calls, methods, receivers).
PROPAGATORS = (
    ("js.json", "args_to_result", "JSON.{stringify,parse}", "", ""),
    ("js.globals", "args_to_result", "{String,Number,Boolean,BigInt,Symbol,Date,URL,URLSearchParams,Map,Set,WeakMap,WeakSet,Error,TypeError,RangeError,SyntaxError,Headers,Request,Response,FormData,Blob,TextEncoder,TextDecoder,AbortController} {String,Number,Boolean,BigInt,Symbol,Date,URL,URLSearchParams,Error,TypeError,RangeError,SyntaxError,Headers,Request,Response,FormData,Blob,TextEncoder,TextDecoder,AbortController}()** {Map,Set,WeakMap,WeakSet}().* {Array,Object,Promise,Buffer,Math,Intl,Reflect,Number,String,Date,Response}.** {structuredClone,encodeURIComponent,encodeURI,decodeURIComponent,decodeURI,escape,unescape,btoa,atob,parseInt,parseFloat,require,setTimeout,setInterval,setImmediate,clearTimeout,clearInterval,queueMicrotask,requestAnimationFrame,cancelAnimationFrame,dispatchEvent,addEventListener,removeEventListener} {Uint8Array,Uint16Array,Uint32Array,Int8Array,Int16Array,Int32Array,Float32Array,Float64Array,BigInt64Array,ArrayBuffer,DataView,File,FileReader,Event,CustomEvent,StorageEvent,MessageEvent,ResizeObserver,IntersectionObserver,MutationObserver,ClipboardItem,AbortSignal,ReadableStream,WritableStream,TransformStream,Image,Option}{,()}** {process,globalThis,window,document,navigator,performance}.**", "", ""),
    ("js.data-methods", "args_to_result", "", "toLowerCase toUpperCase toLocaleLowerCase toLocaleUpperCase trim trimStart trimEnd split slice substring substr replace replaceAll concat join toString padStart padEnd normalize at charAt charCodeAt codePointAt repeat toFixed toPrecision toISOString toJSON toUTCString toDateString valueOf flat reverse entries keys values catch finally json text clone get getAll reduce reduceRight match matchAll search format encode decode", ""),
    ("js.mutators", "args_to_receiver", "", "push unshift splice add set append fill", ""),
    ("js.callbacks", "receiver_to_callback", "", "map forEach filter find findLast findIndex some every flatMap sort then", ""),
    ("js.message-builders", "args_to_receiver", "mailersend:{EmailParams,Recipient,Sender,SMSParams,Attachment} mailersend:{EmailParams,SMSParams}()**", "", ""),
    ("js.databases", "none", "{@prisma/client,drizzle-orm,mongoose,typeorm,sequelize,knex,kysely,pg,postgres,mysql2,better-sqlite3,sqlite3,mongodb,redis,ioredis,@upstash/redis,@neondatabase/serverless,@vercel/postgres,@planetscale/database,@libsql/client}:** {drizzle-orm,@prisma/client,mongodb}/*:**", "", "prisma tx trx knex db dbClient"),
    ("js.service-clients", "args_only", "{pino,winston,bunyan,nodemailer,ai,@ai-sdk/*,stripe,inngest,@aws-sdk/*,@azure/*,@google-cloud/*,@slack/*}:**", "", ""),
    ("js.internal-modules", "args_to_result", "{zod,yup,joi,class-validator,class-transformer,valibot,ajv,superstruct}:** {lodash,lodash-es,ramda,underscore,immer}:** lodash/*:** {date-fns,dayjs,moment,luxon,uuid,nanoid,cuid,@paralleldrive/cuid2,slugify,validator,qs,query-string}:** {crypto,jsonwebtoken,jose,bcrypt,bcryptjs,argon2}:** {react,react-dom,react-dom/server,next,next/server,next/navigation,next/cache,next/router,next/link,next/image,next/font/*}:** {express,fastify,cors,helmet,body-parser,cookie-parser,express-session,compression,morgan}:** {path,fs,fs/promises,os,url,util,events,stream,zlib,buffer,querystring,assert,child_process,worker_threads,timers,timers/promises,string_decoder}:** {dotenv,dotenv/config,@t3-oss/env-nextjs,@t3-oss/env-core}:** {clsx,classnames,tailwind-merge,class-variance-authority}:** {react-hook-form,@hookform/resolvers,@hookform/resolvers/zod,formik,@tanstack/react-query,@tanstack/react-table,@tanstack/react-router,swr,zustand,jotai,valtio,mobx,redux,@reduxjs/toolkit,react-redux}:** {@radix-ui/*,@headlessui/react,@heroicons/react/*,lucide-react,framer-motion,motion,motion/react,sonner,react-hot-toast,react-toastify,cmdk,vaul,recharts,konva,react-konva,react-dropzone,react-pdf,react-markdown}:** {@lingui/*,@lingui/core/macro,@lingui/react/macro,i18next,react-i18next,next-intl,next-i18next,@formatjs/*,react-intl}:** {ts-pattern,remeda,type-fest,superjson,devalue,nanoid/non-secure,p-limit,p-map,p-queue,async,eventemitter3,mitt}:** {@trpc/client,@trpc/react-query,@trpc/next,@ts-rest/core,@ts-rest/react-query,react-router,react-router-dom,@remix-run/react,next-auth/react,@auth/core,next-themes}:** {pdf-lib,@cantoo/pdf-lib,@libpdf/core,pdfjs-dist,pdfjs-dist/*,sharp,jimp,qrcode,papaparse,csv-parse,csv-parse/sync,csv-stringify,xlsx,exceljs,marked,dompurify,isomorphic-dompurify,sanitize-html,he,entities,mime,mime-types,file-type,fflate,jszip,content-disposition,@sindresorhus/slugify,ua-parser-js,isbot,colord}:** {react-email,@react-email/*,nuqs,react-call,@hello-pangea/dnd,react-colorful,remix-themes,fumadocs-ui/*,fumadocs-core/*,@dnd-kit/*,react-day-picker,embla-carousel-react,input-otp,react-resizable-panels,usehooks-ts,@uidotdev/usehooks}:** {@noble/*,@scure/*,@oslojs/*,oslo,oslo/*,arctic,@simplewebauthn/*,otplib,speakeasy,uuidv7,@paralleldrive/cuid2}:**", "", ""),
    ("py.builtins", "args_to_result", "builtins.{str,repr,ascii,int,float,complex,dict,list,tuple,set,frozenset,sorted,reversed,enumerate,zip,map,filter,min,max,sum,format,iter,next,bytes,bytearray,round,abs,vars,super,getattr,setattr,open,range,object,slice,divmod,pow,chr,ord,hex,oct,bin,memoryview,property,staticmethod,classmethod} builtins.{Exception,ValueError,TypeError,KeyError,IndexError,RuntimeError,AttributeError,NotImplementedError,PermissionError,LookupError,AssertionError,StopIteration,OSError,IOError} builtins.super()**", "", ""),
    ("py.data-methods", "args_to_result", "", "lower upper strip lstrip rstrip split rsplit splitlines replace join format format_map encode decode title capitalize casefold swapcase zfill ljust rjust center partition rpartition removeprefix removesuffix expandtabs translate copy items keys values get getlist pop popitem model_dump model_dump_json dict json to_dict to_json isoformat strftime hex hexdigest digest first all one one_or_none scalar scalars fetchone fetchall fetchmany", ""),
    ("py.mutators", "args_to_receiver", "", "append extend insert add update setdefault appendleft extendleft", ""),
    ("py.databases", "none", "{sqlalchemy,sqlmodel,peewee,tortoise,pymongo,motor,redis,psycopg,psycopg2,asyncpg,aiosqlite,sqlite3,django.db,mongoengine,databases,prisma}.**", "", "db db_session session dbsession sess conn connection cursor cur tx transaction uow"),
    ("py.message-builders", "args_to_receiver", "email.**.{set_content,add_alternative,add_related,add_attachment,attach,set_payload,add_header,replace_header} flask_mail.Message{,()}.{attach,add_recipient} emails.**.{attach,set_mail_to,set_html,set_text} apprise.Apprise{,()}.add", "", ""),
    ("py.messaging-models", "args_to_result", "flask_mail.{Message,Attachment} fastapi_mail.MessageSchema emails.{html,Message,message.Message,message.html} exponent_server_sdk.PushMessage firebase_admin.messaging.{Message,MulticastMessage,Notification,AndroidConfig,APNSConfig,WebpushConfig} {sib_api_v3_sdk,brevo_python}.{SendSmtpEmail,SendSmtpEmailTo,SendSmtpEmailSender,SendTransacSms}", "", ""),
    ("py.internal-modules", "args_to_result", "{json,pickle,marshal,base64,binascii,copy,dataclasses,typing,typing_extensions,datetime,time,calendar,uuid,re,string,textwrap,unicodedata,math,cmath,decimal,fractions,random,secrets,statistics,enum,functools,itertools,operator,collections,heapq,bisect,array,contextlib,abc,inspect,types,weakref,warnings,traceback,io,os,sys,pathlib,shutil,glob,tempfile,csv,configparser,argparse,getpass,locale,gettext,hashlib,hmac,zlib,gzip,zipfile,tarfile,struct,codecs,asyncio,threading,multiprocessing,concurrent,queue,signal,subprocess,socket,select,selectors,ssl,email,mimetypes,html,xml,urllib.parse,ipaddress,platform,importlib,pkgutil,pprint,dis,ast,tokenize,unittest,doctest}.** {json,copy,uuid,re,os,time,random,secrets,hashlib,hmac,base64,math,datetime,dataclasses,functools,itertools,typing} {blockkit,slack_sdk.models,jinja2,markupsafe,tabulate,dateparser,humanize,arrow,pendulum,tenacity,backoff,cachetools,limits,schedule,apscheduler}.** {pydantic,pydantic_settings,alembic,django,flask,fastapi,starlette,werkzeug,jinja2,marshmallow,attrs,attr,celery,rq,dramatiq,jwt,jose,passlib,bcrypt,argon2,cryptography,nacl,itsdangerous,dotenv,click,typer,rich,tqdm,numpy,pandas,yaml,toml,tomllib,orjson,ujson,msgpack,dateutil,pytz,zoneinfo,babel,email_validator,phonenumbers,validators,slugify,unidecode,bleach,markdown,uvicorn,gunicorn}.**", "", ""),
    ("cs.stringbuilder", "fluent", "System.Text.StringBuilder{,()}**.{Append,AppendLine,AppendFormat,AppendJoin,Insert,Replace}", "Append AppendLine AppendFormat AppendJoin", ""),
    ("cs.linq-callbacks", "receiver_to_callback", "", "Select SelectMany Where OrderBy OrderByDescending ThenBy ThenByDescending GroupBy ForEach First FirstOrDefault Single SingleOrDefault Last LastOrDefault TakeWhile SkipWhile DistinctBy MaxBy MinBy Find FindAll ConvertAll ToDictionary ToLookup Aggregate Max Min", ""),
    ("cs.collections-mutators", "args_to_receiver", "", "Add AddRange Insert InsertRange Enqueue Push TryAdd AddOrUpdate GetOrAdd Prepend AddMessages AddFirst AddLast Set Write TryWrite WriteAsync", ""),
    ("cs.validation", "args_to_result", "FluentValidation.**.{Validate,ValidateAsync,ValidateAndThrow,ValidateAndThrowAsync}", "Validate ValidateAsync ValidateAndThrow ValidateAndThrowAsync TryValidateObject", ""),
    ("cs.callback-result", "callback_result", "System.Threading.Tasks.{Task,ValueTask}.{Run,FromResult} Microsoft.Extensions.AI.AIFunctionFactory.Create", "", ""),
    ("cs.data-methods", "args_to_result", "", "ToLower ToUpper ToLowerInvariant ToUpperInvariant Trim TrimStart TrimEnd Substring Replace Split PadLeft PadRight Remove Normalize ToString ToCharArray ToList ToArray ToHashSet ToListAsync ToArrayAsync AsEnumerable AsQueryable Distinct Reverse Skip Take Concat Union Append GetValueOrDefault GetAwaiter GetResult Format Join Clone CopyTo Cast OfType Zip ElementAt ElementAtOrDefault DefaultIfEmpty", ""),
    ("cs.builtins", "args_to_result", "System.{String,Convert,Math,Guid,DateTime,DateTimeOffset,TimeSpan,Uri,Int32,Int64,Decimal,Double,Boolean,Enum,Nullable,BinaryData,Array,Object,Char,Byte,Version,Environment,BitConverter}{,()}** System.{Linq,Text,Text.Json,Text.RegularExpressions,Collections,Collections.Generic,Collections.Concurrent,Collections.Immutable,Collections.ObjectModel,Threading,Threading.Tasks,Globalization,Buffers,ComponentModel,Reflection,IO,Numerics,Security.Cryptography,Runtime}.** System.{Exception,ArgumentException,ArgumentNullException,ArgumentOutOfRangeException,InvalidOperationException,NotSupportedException,NotImplementedException,KeyNotFoundException,FormatException,UnauthorizedAccessException,ApplicationException}{,()}** System.Text.Json.{JsonSerializer,JsonDocument,JsonElement,JsonSerializerOptions,JsonNamingPolicy,Nodes.JsonNode,Nodes.JsonObject,Nodes.JsonArray}{,()}** System.Text.{Encoding,StringBuilder,RegularExpressions.Regex}{,()}** System.Linq.{Enumerable,Queryable}{,()}** System.Threading.Tasks.{Task,ValueTask,TaskCompletionSource,Parallel}{,()}** System.Collections.Generic.{List,Dictionary,HashSet,IEnumerable,IList,ICollection,IDictionary,KeyValuePair,Queue,Stack,SortedDictionary,IReadOnlyList,IReadOnlyCollection,IReadOnlyDictionary}{,()}** System.IO.{Stream,MemoryStream,StreamReader,StreamWriter,File,Path,Directory}{,()}** System.{IServiceProvider,IDisposable,IAsyncDisposable,Activator,Lazy,Nullable,Action,Func,EventHandler}{,()}** System.Reflection.{Assembly,MethodInfo,PropertyInfo,TypeInfo,BindingFlags}{,()}** Newtonsoft.Json.** System.Net.Http.{StringContent,ByteArrayContent,FormUrlEncodedContent,MultipartFormDataContent,StreamContent,HttpRequestMessage,HttpResponseMessage,HttpMethod,Json.JsonContent,Headers}{,()}** System.Net.{HttpStatusCode,IPAddress,WebUtility}{,()}**", "", ""),
    ("cs.message-builders", "args_to_receiver", "MimeKit.** System.Net.Mail.{MailMessage,MailAddress,Attachment,AlternateView,MailAddressCollection}{,()}** SendGrid.Helpers.Mail.** RestSharp.RestRequest{,()}** Microsoft.Extensions.AI.{ChatMessage,ChatOptions,TextContent,DataContent,ChatResponse,ChatResponseUpdate}{,()}** OpenAI.Chat.{ChatMessage,UserChatMessage,SystemChatMessage,AssistantChatMessage,ChatCompletionOptions}{,()}** Azure.Messaging.ServiceBus.ServiceBusMessage{,()}** Azure.Messaging.EventHubs.EventData{,()}** Confluent.Kafka.{Message,ProducerConfig,ProducerBuilder}{,()}** Amazon.**.Model.** Duende.IdentityServer.Events.** RabbitMQ.Client.{BasicProperties,IBasicProperties}{,()}**", "", ""),
    ("cs.databases", "none", "Microsoft.EntityFrameworkCore.{DbContext,DbSet,DbContextOptions,DbContextOptionsBuilder,ModelBuilder,EntityState,EF,Infrastructure.DatabaseFacade,ChangeTracking.EntityEntry,Storage.IDbContextTransaction}{,()}** Microsoft.EntityFrameworkCore.** Npgsql.** Microsoft.Data.SqlClient.** Microsoft.Data.Sqlite.** MySqlConnector.** StackExchange.Redis.** Dapper.** MongoDB.Driver.** Microsoft.Azure.Cosmos.** Microsoft.AspNetCore.Identity.** Microsoft.Extensions.Caching.** Pgvector.**", "", ""),
    ("cs.internal-modules", "args_to_result", "Microsoft.Extensions.{DependencyInjection,Options,Configuration,Hosting,Http,Resilience,ServiceDiscovery,Diagnostics,Primitives,FileProviders,Localization}.** Microsoft.AspNetCore.{Builder,Routing,Http,Hosting,Authorization,Authentication,Components,Mvc,Antiforgery,DataProtection,Cors,ResponseCompression,StaticFiles,Diagnostics,HttpsPolicy,Server,WebUtilities,OutputCaching,RateLimiting,OpenApi}.** Grpc.Core.{RpcException,Status,StatusCode,Metadata,ServerCallContext,ChannelBase,CallOptions}{,()}** {Asp.Versioning,Polly,OpenTelemetry,FluentValidation,Grpc,Google.Protobuf,Duende.IdentityServer,Duende.IdentityModel,IdentityModel,Aspire,MediatR,AutoMapper,Scalar,Swashbuckle,Microsoft.OpenApi,Microsoft.IdentityModel,System.IdentityModel,Microsoft.Identity.Web,Serilog.Extensions,HealthChecks}.** System.Security.Claims.{ClaimsPrincipal,ClaimsIdentity,Claim,ClaimTypes}{,()}** System.Diagnostics.{Stopwatch,ActivitySource,Metrics,DiagnosticSource,StackTrace,Process}{,()}**", "", ""),
)
# Fields that hold a number about a value, (language, names).
NON_PROPAGATING_FIELDS = (
    ("javascript", "length size byteLength"),
    ("csharp", "Length Count LongLength Capacity HasValue IsEmpty"),
)
# Fields that read what an object holds, (language, names).
ACCESSOR_FIELDS = (
    ("csharp", "Value Result Current Item Items Values Keys Key InnerException"),
)
# Methods of plain values, (language, names).
VALUE_METHODS = (
    ("javascript", "toLowerCase toUpperCase toLocaleLowerCase toLocaleUpperCase trim trimStart trimEnd split includes startsWith endsWith replace replaceAll slice substring substr indexOf lastIndexOf match matchAll search toString valueOf localeCompare normalize padStart padEnd charAt charCodeAt codePointAt at concat repeat lower upper strip lstrip rstrip startswith endswith encode decode format casefold title capitalize find rfind index count join isdigit isalpha isalnum zfill partition rpartition removeprefix removesuffix splitlines expandtabs translate"),
    ("python", "toLowerCase toUpperCase toLocaleLowerCase toLocaleUpperCase trim trimStart trimEnd split includes startsWith endsWith replace replaceAll slice substring substr indexOf lastIndexOf match matchAll search toString valueOf localeCompare normalize padStart padEnd charAt charCodeAt codePointAt at concat repeat lower upper strip lstrip rstrip startswith endswith encode decode format casefold title capitalize find rfind index count join isdigit isalpha isalnum zfill partition rpartition removeprefix removesuffix splitlines expandtabs translate"),
    ("csharp", "ToLower ToUpper ToLowerInvariant ToUpperInvariant Trim TrimStart TrimEnd Split Contains StartsWith EndsWith Replace Substring IndexOf LastIndexOf IndexOfAny PadLeft PadRight Remove Insert Normalize ToString Equals CompareTo GetHashCode ToCharArray AsSpan AsMemory EnumerateRunes IsNormalized Format Join Concat"),
)
# Types whose values describe code, (language, names).
METADATA_TYPES = (
    ("csharp", "System.Type System.Reflection.** System.Type.** System.Reflection.Assembly{,()}**"),
)
# Fixed values: (id, removed categories, calls, methods).
SANITISERS = (
    ("js.password-hash", "user.authorization", "{bcrypt,bcryptjs,@node-rs/bcrypt}:{hash,hashSync} {argon2,@node-rs/argon2}:hash crypto:{scrypt,scryptSync,pbkdf2,pbkdf2Sync}", ""),
    ("js.predicates", "*", "Array.isArray Number.{isNaN,isFinite,isInteger} {isNaN,isFinite} Object.is {bcrypt,bcryptjs,@node-rs/bcrypt}:{compare,compareSync} {argon2,@node-rs/argon2}:verify", "includes startsWith endsWith test has indexOf lastIndexOf localeCompare isValid"),
    ("py.password-hash", "user.authorization", "bcrypt.hashpw passlib.**.{hash,encrypt} argon2.PasswordHasher().hash werkzeug.security.generate_password_hash django.contrib.auth.hashers.make_password hashlib.{pbkdf2_hmac,scrypt}", ""),
    ("py.predicates", "*", "builtins.{len,bool,isinstance,issubclass,hasattr,callable,id,type,hash}", "startswith endswith isdigit isalpha isalnum islower isupper isspace isidentifier count find rfind index rindex"),
    ("cs.password-hash", "user.authorization", "Microsoft.AspNetCore.Identity.{IPasswordHasher,PasswordHasher}{,()}**.HashPassword BCrypt.Net.BCrypt.{HashPassword,EnhancedHashPassword,HashString} System.Security.Cryptography.Rfc2898DeriveBytes{,()}**.{Pbkdf2,GetBytes} Microsoft.AspNetCore.Cryptography.KeyDerivation.KeyDerivation.Pbkdf2 Isopoh.Cryptography.Argon2.Argon2.Hash Konscious.Security.Cryptography.Argon2id{,()}**.GetBytes", ""),
    ("cs.predicates", "*", "System.String.{IsNullOrEmpty,IsNullOrWhiteSpace,Equals,Compare,CompareOrdinal} System.Text.RegularExpressions.Regex{,()}**.IsMatch BCrypt.Net.BCrypt.{Verify,EnhancedVerify} System.Object.ReferenceEquals **.{GetType,GetHashCode}", "Contains StartsWith EndsWith Equals SequenceEqual Any All Count LongCount Sum Average IndexOf LastIndexOf CompareTo IsMatch Exists ContainsKey VerifyHashedPassword Verify GetHashCode GetType TryParse IsNullOrEmpty IsNullOrWhiteSpace"),
)
# Fixed values: (id, kind, framework, category, reads, calls).
SOURCES = (
    ("js.express.handler", "handler", "Express", None, "", ""),
    ("js.fastify.handler", "handler", "Fastify", None, "", ""),
    ("js.next.app-route", "route_export", "Next.js", None, "", ""),
    ("js.next.pages-api", "route_export", "Next.js", None, "", ""),
    ("js.next.headers", "read", "Next.js", "unknown", "", "next/headers:{cookies,headers}"),
    ("py.flask.request", "read", "Flask", "unknown", "flask.request.{form,args,values,json,files,cookies,headers,data,authorization,remote_addr}", "flask.request.{get_json,get_data}"),
    ("py.fastapi.handler", "handler", "FastAPI", None, "", ""),
    ("py.django.view", "handler", "Django", None, "", ""),
    ("cs.aspnetcore.minimal-api", "handler", "ASP.NET Core", None, "", ""),
    ("cs.aspnetcore.mvc", "handler", "ASP.NET Core MVC", None, "", ""),
    ("cs.grpc.service", "handler", "gRPC", None, "", ""),
    ("cs.aspnetcore.request", "read", "ASP.NET Core", "unknown", "Microsoft.AspNetCore.**.{Request,HttpRequest}.{Query,Form,Headers,Cookies,RouteValues,Body,BodyReader,QueryString,Path} Grpc.Core.ServerCallContext.RequestHeaders", "Microsoft.AspNetCore.**.{Request,HttpRequest}.{ReadFromJsonAsync,ReadFormAsync} Microsoft.AspNetCore.**.{Request,HttpRequest}.{Query,Form,Headers,Cookies,RouteValues}.{TryGetValue,GetValueOrDefault}"),
    ("cs.aspnetcore.remote-ip", "read", "ASP.NET Core", "user.device.ip_address", "Microsoft.AspNetCore.**.Connection.RemoteIpAddress Grpc.Core.ServerCallContext.Peer", ""),
    ("cs.claims", "read", None, "unknown", "", "System.Security.Claims.{ClaimsPrincipal,ClaimsIdentity}{,()}**.{FindFirst,FindFirstValue,FindAll} {Microsoft.AspNetCore,Grpc}.**.{User,Principal}.{FindFirst,FindFirstValue,FindAll}"),
    ("cs.claims.list", "read", None, "user", "System.Security.Claims.{ClaimsPrincipal,ClaimsIdentity}{,()}**.Claims {Microsoft.AspNetCore,Grpc}.**.{User,Principal}.Claims", ""),
    ("cs.claims.identity-name", "read", None, "user.account.username", "System.Security.Claims.{ClaimsPrincipal,ClaimsIdentity,IIdentity}{,()}**.Name {Microsoft.AspNetCore,Grpc}.**.User.Identity.Name", ""),
    ("cs.blazor.bind", "read", "Blazor", "unknown", "Microsoft.AspNetCore.Components.ChangeEventArgs{,()}.Value", "Microsoft.AspNetCore.Components.EventCallbackFactoryBinderExtensions.CreateBinder"),
    ("cs.blazor.supplied-parameters", "property", "Blazor", None, "", ""),
    ("cs.blazor.route-parameters", "property", "Blazor", None, "", ""),
    ("cs.aspnetcore.bind-property", "property", "ASP.NET Core MVC", None, "", ""),
)
# How handlers are known, (id, way, values); ways: registrations, decorators, files, exports, bases, class_decorators, require, exclude, exclude_decorators, has_param_type.
HANDLERS = (
    ("js.express.handler", "registrations", "express:**.{get,post,put,patch,delete,all,use,options,head}"),
    ("js.fastify.handler", "registrations", "fastify:**.{get,post,put,patch,delete,all,route,options,head}"),
    ("js.next.app-route", "files", "**/app/**/route.{ts,tsx,js,jsx,mjs}"),
    ("js.next.app-route", "exports", "GET POST PUT PATCH DELETE HEAD OPTIONS"),
    ("js.next.pages-api", "files", "**/pages/api/**"),
    ("js.next.pages-api", "exports", "default"),
    ("py.fastapi.handler", "decorators", "fastapi.{FastAPI,APIRouter}().{get,post,put,patch,delete,api_route,websocket}()"),
    ("py.django.view", "files", "**/views.py **/views/**.py **/viewsets.py **/api/views.py"),
    ("cs.aspnetcore.minimal-api", "registrations", "Microsoft.AspNetCore.{Builder.WebApplication,Routing.IEndpointRouteBuilder,Routing.RouteGroupBuilder,Builder.IEndpointConventionBuilder}{,()}**.{MapGet,MapPost,MapPut,MapDelete,MapPatch,MapMethods,MapFallback}"),
    ("cs.aspnetcore.mvc", "bases", "Microsoft.AspNetCore.Mvc.{Controller,ControllerBase}"),
    ("cs.aspnetcore.mvc", "class_decorators", "Microsoft.AspNetCore.Mvc.{ApiControllerAttribute,ControllerAttribute}{,()}"),
    ("cs.aspnetcore.mvc", "require", "public"),
    ("cs.aspnetcore.mvc", "exclude", "static abstract constructor override"),
    ("cs.aspnetcore.mvc", "exclude_decorators", "Microsoft.AspNetCore.Mvc.NonActionAttribute{,()}"),
    ("cs.grpc.service", "has_param_type", "Grpc.Core.ServerCallContext"),
    ("cs.grpc.service", "require", "override"),
    ("cs.blazor.supplied-parameters", "decorators", "Microsoft.AspNetCore.Components.{SupplyParameterFromFormAttribute,SupplyParameterFromQueryAttribute}{,()}"),
    ("cs.blazor.route-parameters", "decorators", "Microsoft.AspNetCore.Components.ParameterAttribute{,()}"),
    ("cs.blazor.route-parameters", "class_decorators", "Microsoft.AspNetCore.Components.RouteAttribute{,()}"),
    ("cs.aspnetcore.bind-property", "decorators", "Microsoft.AspNetCore.Mvc.BindPropertyAttribute{,()}"),
)
# What handlers' parameters carry, (id, which, how, name or patterns, category).
PARAMETERS = (
    ("js.express.handler", "index 0", "fields", "body", "unknown"),
    ("js.express.handler", "index 0", "fields", "query", "unknown"),
    ("js.express.handler", "index 0", "fields", "params", "unknown"),
    ("js.express.handler", "index 0", "fields", "cookies", "unknown"),
    ("js.express.handler", "index 0", "fields", "signedCookies", "unknown"),
    ("js.express.handler", "index 0", "fields", "headers", "unknown"),
    ("js.express.handler", "index 0", "fields", "ip", "user.device.ip_address"),
    ("js.express.handler", "index 0", "fields", "ips", "user.device.ip_address"),
    ("js.express.handler", "index 1", "provenance", "express:Response", None),
    ("js.fastify.handler", "index 0", "fields", "body", "unknown"),
    ("js.fastify.handler", "index 0", "fields", "query", "unknown"),
    ("js.fastify.handler", "index 0", "fields", "params", "unknown"),
    ("js.fastify.handler", "index 0", "fields", "cookies", "unknown"),
    ("js.fastify.handler", "index 0", "fields", "headers", "unknown"),
    ("js.fastify.handler", "index 0", "fields", "ip", "user.device.ip_address"),
    ("js.fastify.handler", "index 1", "provenance", "fastify:Reply", None),
    ("js.next.app-route", "index 0", "methods", "json", "unknown"),
    ("js.next.app-route", "index 0", "methods", "formData", "unknown"),
    ("js.next.app-route", "index 0", "methods", "text", "unknown"),
    ("js.next.app-route", "index 0", "methods", "blob", "unknown"),
    ("js.next.app-route", "index 0", "methods", "arrayBuffer", "unknown"),
    ("js.next.app-route", "index 0", "fields", "nextUrl", "unknown"),
    ("js.next.app-route", "index 0", "fields", "url", "unknown"),
    ("js.next.app-route", "index 0", "fields", "headers", "unknown"),
    ("js.next.app-route", "index 0", "fields", "cookies", "unknown"),
    ("js.next.app-route", "index 0", "fields", "body", "unknown"),
    ("js.next.app-route", "index 0", "fields", "ip", "user.device.ip_address"),
    ("js.next.pages-api", "index 0", "fields", "body", "unknown"),
    ("js.next.pages-api", "index 0", "fields", "query", "unknown"),
    ("js.next.pages-api", "index 0", "fields", "cookies", "unknown"),
    ("js.next.pages-api", "index 0", "fields", "headers", "unknown"),
    ("js.next.pages-api", "index 1", "provenance", "next:NextApiResponse", None),
    ("py.fastapi.handler", "all", "whole", "", "unknown"),
    ("py.fastapi.handler", "all", "typed", "", None),
    ("py.fastapi.handler", "all", "by_name", "", None),
    ("py.fastapi.handler", "all", "skip_types", "Session AsyncSession BackgroundTasks Response JSONResponse WebSocket", None),
    ("py.fastapi.handler", "all", "skip_names", "db session background_tasks response settings", None),
    ("py.fastapi.handler", "type Request", "methods", "json", "unknown"),
    ("py.fastapi.handler", "type Request", "methods", "form", "unknown"),
    ("py.fastapi.handler", "type Request", "methods", "body", "unknown"),
    ("py.fastapi.handler", "type Request", "fields", "query_params", "unknown"),
    ("py.fastapi.handler", "type Request", "fields", "path_params", "unknown"),
    ("py.fastapi.handler", "type Request", "fields", "headers", "unknown"),
    ("py.fastapi.handler", "type Request", "fields", "cookies", "unknown"),
    ("py.django.view", "name request", "fields", "POST", "unknown"),
    ("py.django.view", "name request", "fields", "GET", "unknown"),
    ("py.django.view", "name request", "fields", "body", "unknown"),
    ("py.django.view", "name request", "fields", "COOKIES", "unknown"),
    ("py.django.view", "name request", "fields", "FILES", "unknown"),
    ("py.django.view", "name request", "fields", "META", "unknown"),
    ("py.django.view", "name request", "fields", "headers", "unknown"),
    ("py.django.view", "name request", "fields", "data", "unknown"),
    ("py.django.view", "name request", "fields", "query_params", "unknown"),
    ("cs.aspnetcore.minimal-api", "all", "whole", "", "unknown"),
    ("cs.aspnetcore.minimal-api", "all", "typed", "", None),
    ("cs.aspnetcore.minimal-api", "all", "by_name", "", None),
    ("cs.aspnetcore.minimal-api", "all", "skip_types", "System.Threading.CancellationToken System.Security.Claims.ClaimsPrincipal Microsoft.AspNetCore.Http.{HttpContext,HttpRequest,HttpResponse,IFormFile,IFormFileCollection} Microsoft.Extensions.** Microsoft.EntityFrameworkCore.** Microsoft.AspNetCore.{Identity,Hosting,Antiforgery,Authentication,Authorization,Components,Mvc,Routing,DataProtection}.** MediatR.** System.Net.Http.{HttpClient,IHttpClientFactory} {CancellationToken,ClaimsPrincipal,HttpContext,HttpRequest,HttpResponse,ILogger,ILoggerFactory,IMediator,ISender,IPublisher,IConfiguration,IServiceProvider,IHttpClientFactory,HttpClient,IAntiforgery,IWebHostEnvironment,IHostEnvironment,LinkGenerator,IOptions,IMemoryCache,IDistributedCache,IFormFile,IFormFileCollection,Stream,PipeReader,IMapper,IValidator}", None),
    ("cs.aspnetcore.minimal-api", "all", "classify_only_types", "{Guid,Int16,Int32,Int64,UInt16,UInt32,UInt64,Byte,SByte,Boolean,Decimal,Double,Single,DateTime,DateTimeOffset,DateOnly,TimeOnly,TimeSpan}", None),
    ("cs.aspnetcore.minimal-api", "all", "skip_bases", "Microsoft.EntityFrameworkCore.DbContext Microsoft.AspNetCore.Identity.EntityFrameworkCore.IdentityDbContext", None),
    ("cs.aspnetcore.minimal-api", "all", "skip_interfaces", "", None),
    ("cs.aspnetcore.minimal-api", "all", "skip_attrs", "Microsoft.AspNetCore.Mvc.FromServicesAttribute{,()} Microsoft.Extensions.DependencyInjection.FromKeyedServicesAttribute{,()}", None),
    ("cs.aspnetcore.minimal-api", "all", "expand_attrs", "Microsoft.AspNetCore.Http.AsParametersAttribute{,()}", None),
    ("cs.aspnetcore.minimal-api", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "whole", "", "unknown"),
    ("cs.aspnetcore.minimal-api", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "typed", "", None),
    ("cs.aspnetcore.minimal-api", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "by_name", "", None),
    ("cs.aspnetcore.minimal-api", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "classify_only_types", "{Guid,Int16,Int32,Int64,UInt16,UInt32,UInt64,Byte,SByte,Boolean,Decimal,Double,Single,DateTime,DateTimeOffset,DateOnly,TimeOnly,TimeSpan}", None),
    ("cs.aspnetcore.mvc", "all", "whole", "", "unknown"),
    ("cs.aspnetcore.mvc", "all", "typed", "", None),
    ("cs.aspnetcore.mvc", "all", "by_name", "", None),
    ("cs.aspnetcore.mvc", "all", "skip_types", "System.Threading.CancellationToken System.Security.Claims.ClaimsPrincipal Microsoft.AspNetCore.Http.{HttpContext,HttpRequest,HttpResponse,IFormFile,IFormFileCollection} Microsoft.Extensions.** Microsoft.EntityFrameworkCore.** Microsoft.AspNetCore.{Identity,Hosting,Antiforgery,Authentication,Authorization,Components,Mvc,Routing,DataProtection}.** MediatR.** System.Net.Http.{HttpClient,IHttpClientFactory} {CancellationToken,ClaimsPrincipal,HttpContext,HttpRequest,HttpResponse,ILogger,ILoggerFactory,IMediator,ISender,IPublisher,IConfiguration,IServiceProvider,IHttpClientFactory,HttpClient,IAntiforgery,IWebHostEnvironment,IHostEnvironment,LinkGenerator,IOptions,IMemoryCache,IDistributedCache,IFormFile,IFormFileCollection,Stream,PipeReader,IMapper,IValidator}", None),
    ("cs.aspnetcore.mvc", "all", "classify_only_types", "{Guid,Int16,Int32,Int64,UInt16,UInt32,UInt64,Byte,SByte,Boolean,Decimal,Double,Single,DateTime,DateTimeOffset,DateOnly,TimeOnly,TimeSpan}", None),
    ("cs.aspnetcore.mvc", "all", "skip_bases", "Microsoft.EntityFrameworkCore.DbContext Microsoft.AspNetCore.Identity.EntityFrameworkCore.IdentityDbContext", None),
    ("cs.aspnetcore.mvc", "all", "skip_interfaces", "", None),
    ("cs.aspnetcore.mvc", "all", "skip_attrs", "Microsoft.AspNetCore.Mvc.FromServicesAttribute{,()} Microsoft.Extensions.DependencyInjection.FromKeyedServicesAttribute{,()}", None),
    ("cs.aspnetcore.mvc", "all", "expand_attrs", "Microsoft.AspNetCore.Http.AsParametersAttribute{,()}", None),
    ("cs.aspnetcore.mvc", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "whole", "", "unknown"),
    ("cs.aspnetcore.mvc", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "typed", "", None),
    ("cs.aspnetcore.mvc", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "by_name", "", None),
    ("cs.aspnetcore.mvc", "attr Microsoft.AspNetCore.Mvc.{FromBodyAttribute,FromQueryAttribute,FromRouteAttribute,FromHeaderAttribute,FromFormAttribute}{,()}", "classify_only_types", "{Guid,Int16,Int32,Int64,UInt16,UInt32,UInt64,Byte,SByte,Boolean,Decimal,Double,Single,DateTime,DateTimeOffset,DateOnly,TimeOnly,TimeSpan}", None),
    ("cs.grpc.service", "all", "whole", "", "unknown"),
    ("cs.grpc.service", "all", "typed", "", None),
    ("cs.grpc.service", "all", "skip_types", "Grpc.Core.{ServerCallContext,IServerStreamWriter} {ServerCallContext,IServerStreamWriter}", None),
    ("cs.blazor.supplied-parameters", "all", "whole", "", "unknown"),
    ("cs.blazor.supplied-parameters", "all", "typed", "", None),
    ("cs.blazor.route-parameters", "all", "whole", "", "unknown"),
    ("cs.blazor.route-parameters", "all", "typed", "", None),
    ("cs.aspnetcore.bind-property", "all", "whole", "", "unknown"),
    ("cs.aspnetcore.bind-property", "all", "typed", "", None),
)
# Categories of claims by their type, (name, category).
CLAIM_TYPES = (
    ("sub", "user.unique_id.pseudonymous"),
    ("nameidentifier", "user.unique_id.pseudonymous"),
    ("oid", "user.unique_id.pseudonymous"),
    ("name", "user.name"),
    ("givenname", "user.name.first"),
    ("given_name", "user.name.first"),
    ("surname", "user.name.last"),
    ("family_name", "user.name.last"),
    ("preferred_username", "user.account.username"),
    ("emailaddress", "user.contact.email"),
    ("email", "user.contact.email"),
    ("mobilephone", "user.contact.phone_number"),
    ("phone_number", "user.contact.phone_number"),
    ("address_street", "user.contact.address.street"),
    ("address_city", "user.contact.address.city"),
    ("address_state", "user.contact.address.state"),
    ("address_country", "user.contact.address.country"),
    ("address_zip_code", "user.contact.address.postal_code"),
    ("streetaddress", "user.contact.address.street"),
    ("dateofbirth", "user.demographic.date_of_birth"),
)
# Fixed values: (id, calls, argument, implemented type, method, parameter, type argument).
DISPATCHERS = (
    ("cs.mediatr.request", "MediatR.{IMediator,ISender,Mediator}{,()}**.{Send,CreateStream}", 0, "MediatR.{IRequestHandler,IStreamRequestHandler}", "Handle", 0, 0),
    ("cs.mediatr.request", "MediatR.{IMediator,ISender,Mediator}{,()}**.{Send,CreateStream}", 0, "MediatR.{IPipelineBehavior,IStreamPipelineBehavior}", "Handle", 0, 0),
    ("cs.mediatr.request", "MediatR.{IMediator,ISender,Mediator}{,()}**.{Send,CreateStream}", 0, "MediatR.Pipeline.{IRequestPreProcessor,IRequestPostProcessor}", "Process", 0, 0),
    ("cs.mediatr.notification", "MediatR.{IMediator,IPublisher,Mediator}{,()}**.Publish", 0, "MediatR.INotificationHandler", "Handle", 0, 0),
)
# Fixed values: (name, language, modules, supported, types).
FRAMEWORKS = (
    ("Express", "javascript", "express", True, ""),
    ("Fastify", "javascript", "fastify", True, ""),
    ("Next.js", "javascript", "next next/server next/headers", True, ""),
    ("Koa", "javascript", "koa @koa/router koa-router", False, ""),
    ("Hapi", "javascript", "@hapi/hapi hapi", False, ""),
    ("NestJS", "javascript", "@nestjs/core @nestjs/common", False, ""),
    ("Hono", "javascript", "hono", False, ""),
    ("Elysia", "javascript", "elysia", False, ""),
    ("Remix", "javascript", "@remix-run/node @remix-run/server-runtime @remix-run/cloudflare", False, ""),
    ("SvelteKit", "javascript", "@sveltejs/kit", False, ""),
    ("Nuxt / h3", "javascript", "nuxt h3", False, ""),
    ("Restify", "javascript", "restify", False, ""),
    ("AdonisJS", "javascript", "@adonisjs/core", False, ""),
    ("Slack Bolt", "javascript", "@slack/bolt", False, ""),
    ("tRPC", "javascript", "@trpc/server @hono/trpc-server", False, ""),
    ("ts-rest server", "javascript", "@ts-rest/serverless @ts-rest/express @ts-rest/nest @ts-rest/fastify", False, ""),
    ("GraphQL servers", "javascript", "@apollo/server apollo-server apollo-server-express graphql-yoga mercurius type-graphql", False, ""),
    ("FastAPI", "python", "fastapi", True, ""),
    ("Flask", "python", "flask", True, ""),
    ("Django", "python", "django rest_framework", True, ""),
    ("aiohttp server", "python", "aiohttp.web", False, ""),
    ("Tornado", "python", "tornado", False, ""),
    ("Sanic", "python", "sanic", False, ""),
    ("Falcon", "python", "falcon", False, ""),
    ("Pyramid", "python", "pyramid", False, ""),
    ("Bottle", "python", "bottle", False, ""),
    ("Quart", "python", "quart", False, ""),
    ("Litestar", "python", "litestar", False, ""),
    ("Starlette (direct)", "python", "starlette.applications starlette.routing", False, ""),
    ("GraphQL servers", "python", "graphene strawberry ariadne", False, ""),
    ("Slack Bolt", "python", "slack_bolt", False, ""),
    ("ASP.NET Core", "csharp", "Microsoft.AspNetCore.Builder Microsoft.AspNetCore.Routing Microsoft.AspNetCore.Http", True, ""),
    ("ASP.NET Core MVC", "csharp", "Microsoft.AspNetCore.Mvc", True, ""),
    ("Blazor", "csharp", "Microsoft.AspNetCore.Components", True, ""),
    ("gRPC", "csharp", "Grpc.AspNetCore Grpc.Core", True, ""),
    ("SignalR", "csharp", "Microsoft.AspNetCore.SignalR", False, "Microsoft.AspNetCore.SignalR.{Hub,Hub`1}"),
    ("Azure Functions", "csharp", "Microsoft.Azure.Functions.Worker Microsoft.Azure.WebJobs", False, "Microsoft.Azure.Functions.Worker.FunctionAttribute{,()} Microsoft.Azure.WebJobs.FunctionNameAttribute{,()}"),
    ("Orleans", "csharp", "Orleans", False, "Orleans.Grain{,`1}"),
    ("Razor Pages", "csharp", "Microsoft.AspNetCore.Mvc.RazorPages", False, "Microsoft.AspNetCore.Mvc.RazorPages.PageModel"),
    ("FastEndpoints", "csharp", "FastEndpoints", False, "FastEndpoints.{Endpoint,EndpointWithoutRequest}"),
    ("GraphQL servers", "csharp", "HotChocolate GraphQL", False, ""),
    ("CoreWCF", "csharp", "CoreWCF", False, ""),
    ("ASP.NET (.NET Framework)", "csharp", "System.Web.Mvc System.Web.Http System.Web.UI", False, ""),
)
# Calls that show data on the device, (id, calls, reason).
PRESENTATION = (
    ("cs.maui.dialogs", "{Microsoft.Maui.Controls.,}{Shell,Page}{,.Current}.{DisplayAlert,DisplayAlertAsync,DisplayActionSheet,DisplayActionSheetAsync,DisplayPromptAsync}", "shows a dialog on the device"),
    ("cs.maui.navigation", "{Microsoft.Maui.Controls.,}Shell{,.Current}.GoToAsync", "navigates to another page of the app; the parameters stay in the app"),
    ("cs.maui.bindable", "{Microsoft.Maui.Controls.,}BindableObject.SetValue", "sets a bindable property of a control"),
    ("cs.maui.animation", "{Microsoft.Maui.Controls.,}Animation{,()}.Commit **.AbortAnimation", "runs or stops an animation of a view"),
)
